"""Personal data under format-preserving pseudonyms. DataFrame functions only.

Validated numbers (cards, bank accounts, social security numbers, phones, addresses of
machines) and dates are permuted within their own format by a keyed Feistel network:
one value gives one pseudonym wherever it stands, different values stay different,
check digits stay right, and ``reveal=True`` undoes it with the same key. Mail addresses
get keyed names. What fails its validation is no personal data and stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates from 1900-01-01 on, as many days as the product; others stay.
DAYS = (340, 215)
_OPEN, _CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_APART, _ALONE = r"(?<![A-Za-z0-9_-])", r"(?![A-Za-z0-9_-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters of a bank account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_SIZES = sorted(set(IBAN_LENGTHS.values()))
_IBAN = "|".join(rf"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == size)})\d{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size in _SIZES)
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _CLOSE
_SSN = r"\d{3}-\d{2}-\d{4}" + _ALONE
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![A-Za-z0-9_]|\.\d)"
_LOCAL = r"(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})" + _ALONE
#: A card in a usual grouping that begins as card networks do, perhaps with three digits behind it.
_CARD = (
    r"(?=[3-6]|2(?:2(?:2[1-9]|[3-9])|[3-6]|7(?:[01]|20)))(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{3}"
    + _ALONE + r")?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})" + _ALONE
)
#: Longer runs of digit groups end before a blank and one of these.
_STOP = rf"(?! (?:{'|'.join((_CARD, _DATE, _SSN, _IP, _LOCAL))}))"
#: Country calling codes of one digit and of two; all others have three.
_CODE_1, _CODE_2 = "^[17]", "^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Kind: pattern, tried in this order. Validation by value follows.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"{_OPEN}(?:{_IBAN}){_CLOSE}",
    "date": _OPEN + _DATE,
    "ssn": _APART + _SSN,
    "ip": r"(?<![A-Za-z0-9_.])" + _IP,
    "phone": rf"(?:(?<![A-Za-z0-9_+])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:{_STOP}[ .-]?\d{{2,4}}){{2,4}}|(?<![A-Za-z0-9_])(?=\(){_LOCAL}|{_APART}{_LOCAL}){_ALONE}",
    "card": rf"{_APART}(?:{_CARD}|(?:\d{_STOP}[ -]?){{12,18}}\d{_ALONE})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(left: Column, right: Column, most_left: Column | int, most_right: Column | int, key: str, tweak: Column | str, reveal: bool) -> Column:
    """A keyed permutation of the pairs below (most_left, most_right): struct l, r."""
    most_left, most_right, tweak = (F.lit(x) if isinstance(x, (int, str)) else x for x in (most_left, most_right, tweak))

    def mask(r: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint") * (-1 if reveal else 1)

    def step(s: Column, r: Column) -> Column:
        l_, r_ = s["l"], s["r"]
        return F.struct(
            F.when(r % 2 == 0, F.pmod(l_ + F.pmod(mask(r, r_), most_left), most_left)).otherwise(l_).alias("l"),
            F.when(r % 2 == 1, F.pmod(r_ + F.pmod(mask(r, l_), most_right), most_right)).otherwise(r_).alias("r"),
        )

    rounds = range(ROUNDS, 0, -1) if reveal else range(1, ROUNDS + 1)
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _tens(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("bigint")


def permuted_digits(digits: Column, key: str, kind: Column | str, reveal: bool) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), a).cast("bigint"), F.substring(digits, a + 1, n - a).cast("bigint")
    tweak = F.concat(kind, n.cast("string"))
    out = feistel(left, right, _tens(a), _tens(n - a), key, tweak, reveal)
    return _let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), n - a, "0")))


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one after another, by those of ``digits``."""
    each = F.sequence(F.lit(1), F.length(shape))

    def char(i: Column) -> Column:
        own = F.substring(shape, i, F.lit(1))
        return F.when(own.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(own)

    return F.array_join(F.transform(each, char), "")


def luhn(digits: Column, first_doubled: bool) -> Column:
    """Luhn sum of a string of digits from the right; whether the last digit is doubled."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = (i % 2 == 1) if first_doubled else (i % 2 == 0)
        return s + F.when(double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn(digits, False) % 10 == 0)


def _card(m: Column, key: str, reveal: bool) -> Column:
    """The first four digits stay: they name the network, by which cards are told from what stands beside them."""

    def valid(d: Column) -> Column:
        n, network = F.length(d), F.substring(d, 1, 4)
        body = permuted_digits(F.substring(d, F.lit(5), n - 5), key, F.concat(F.lit("card"), network), reveal)
        whole = _let(F.concat(network, body), lambda b: F.concat(b, F.pmod(-luhn(b, True), F.lit(10)).cast("string")))
        return F.when(_is_card(d), _let(whole, lambda w: refilled(m, w))).otherwise(m)

    return _let(_digits(m), valid)


def _iban(m: Column, key: str, reveal: bool) -> Column:
    def valid(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

        def checked(new: Column) -> Column:
            rest = refilled(body, new)
            return _let(rest, lambda b: refilled(m, F.concat(F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), _digits(b))))

        ok = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & (F.length(_digits(body)) >= 2)
        return F.when(ok, _let(permuted_digits(_digits(body), key, "iban", reveal), checked)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), valid)


def _ssn(m: Column, key: str, reveal: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", reveal)

    def shown(s: Column) -> Column:
        area = F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)
        parts = ((area, 3), (F.floor(s["r"] / 9999) + 1, 2), (s["r"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(ok, _let(out, shown)).otherwise(m)


def _ip(m: Column, key: str, reveal: bool) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    out = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65536, 65536, key, "ip", reveal)
    return _let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _phone(m: Column, key: str, reveal: bool) -> Column:
    """The country's code stays, as the digits tell it, so that a number is the same in all its shapes."""

    def shown(d: Column) -> Column:
        size = F.when(~m.startswith("+"), 0).when(d.rlike(_CODE_1), 1).when(d.rlike(_CODE_2), 2).otherwise(3)
        new = permuted_digits(F.substring(d, size + 1, F.length(d)), key, "phone", reveal)
        return F.when(F.length(d).between(7, 15), _let(new, lambda x: refilled(m, F.concat(F.substring(d, F.lit(1), size), x)))).otherwise(m)

    return _let(_digits(m), shown)


def _date(m: Column, key: str, reveal: bool) -> Column:
    def part(a: int, n: int) -> Column:
        return F.substring(m, a, n)

    iso, dotted = m.contains("-"), m.contains(".")
    day_first = dotted | (part(1, 2).cast("int") > 12)
    text = F.when(iso, m).when(day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    number = F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.to_date(F.lit("1900-01-01")))

    def shown(n: Column) -> Column:
        out = feistel(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, "date", reveal)
        new = _let(out, lambda s: F.date_add(F.to_date(F.lit("1900-01-01")), (s["l"] * DAYS[1] + s["r"]).cast("int")))

        def formatted(d: Column) -> Column:
            return F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(dotted, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))

        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _let(new, formatted)).otherwise(m)

    return _let(number, shown)


def _email(m: Column, key: str, reveal: bool) -> Column:
    """A keyed name; this one can't be undone."""
    if reveal:
        return m
    low = F.lower(m)
    name, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)

    def code(kind: str, x: Column, n: int) -> Column:
        return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), x), 256), 1, n)

    return F.concat(F.lit("user-"), code("name", name, 12), F.lit("@host-"), code("host", host, 8), F.lit(".example"))


_HOW = {"date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone}


def _hit(kind: str, value: Column, pseudonym: Column, head: Column | str = "", tail: Column | str = "") -> Column:
    head, tail = (F.lit(x) if isinstance(x, str) else x for x in (head, tail))
    names = {"kind": F.lit(kind), "value": value, "pseudonym": F.coalesce(pseudonym, value), "head": head, "tail": tail}
    return F.struct(*[x.alias(name) for name, x in names.items()])


def _card_hit(m: Column, key: str, reveal: bool, head: Column | str = "") -> Column:
    """Sixteen digits with three behind them are one card of 16 if that is valid, else one of 19."""
    short = F.substring(m, 1, 19)
    beside = m.rlike(r"^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{3}$") & _is_card(_digits(short))
    return F.when(beside, _hit("card", short, _card(short, key, reveal), head, F.substring(m, 20, 4))).otherwise(_hit("card", m, _card(m, key, reveal), head))


def _iban_hit(m: Column, key: str, reveal: bool) -> Column:
    """What is no account may still be a word like AT20 before a card."""

    def checked(new: Column) -> Column:
        rest = F.substring(m, F.lit(6), F.length(m))
        return F.when((new == m) & rest.rlike(f"^{_CARD}$"), _card_hit(rest, key, reveal, F.substring(m, 1, 5))).otherwise(_hit("iban", m, new))

    return _let(_iban(m, key, reveal), checked)


def _pseudonym(m: Column, key: str, reveal: bool) -> Column:
    out = F.when(m.contains("@"), _hit("email", m, _email(m, key, reveal)))
    for kind, how in _HOW.items():
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), _hit(kind, m, how(m, key, reveal)))
    return out.when(m.rlike("^[A-Z]"), _iban_hit(m, key, reveal)).otherwise(_card_hit(m, key, reveal))


def pseudonymised(docs: DataFrame, key: str, reveal: bool = False, found: str | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns and ``text`` under pseudonyms.

    With ``found`` a column of that name is added: an array of (kind, value, pseudonym)
    in the order of the text; it replaces a column of that name. Null texts stay null
    (found: empty), texts without personal data stay as they are, rows are treated one
    by one. ``reveal`` turns pseudonyms of numbers and ISO or dotted dates back; of cards of
    19 digits in groups one in ten comes back wrong, as it reads as a card of 16 and a number."""
    text = F.col("text").cast("string")
    hits = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _pseudonym(m, key, reveal))
    kind = "array<struct<kind:string,value:string,pseudonym:string,head:string,tail:string>>"
    hits = F.when(text.rlike("[0-9@]"), hits).otherwise(F.array()).cast(kind)
    taken = {c.lower() for c in docs.columns}
    name = found or next(n for n in (f"found_{i}" for i in range(len(taken) + 1)) if n not in taken)
    columns = [c for c in docs.columns if c != name]
    rows = docs.select(*columns).withColumn(name, F.coalesce(hits, F.array().cast(kind)))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col(name), lambda gap, hit: F.concat(gap, F.coalesce(F.concat(hit["head"], hit["pseudonym"], hit["tail"]), F.lit(""))))
    rows = rows.withColumn("text", F.when(F.size(name) > 0, F.array_join(pieces, "")).otherwise(text))
    changed = F.filter(name, lambda x: x["value"] != x["pseudonym"])
    plain = F.transform(changed, lambda x: F.struct(x["kind"], x["value"], x["pseudonym"]))
    return rows.withColumn(name, plain) if found else rows.select(*columns)
