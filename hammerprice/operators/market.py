"""Small rules of a market's upkeep: brands, weights, term classes, routes, gates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import ladders

#: Makers of bars, the first that a title has counts.
BRANDS = [
    ("PAMP", r"\bpamp\b"),
    ("Valcambi", r"\bvalcambi\b"),
    ("Credit Suisse", r"\bcredit\s*suisse\b"),
    ("Perth Mint", r"\bperth\s*mint\b"),
    ("RCM", r"\broyal\s*canadian\b"),
    ("JM", r"\bjohnson\s*matthey\b|\bjm\b"),
    ("Engelhard", r"\bengelhard\b"),
    ("Sunshine", r"\bsunshine\b"),
    ("Asahi", r"\basahi\b"),
    ("Scottsdale", r"\bscottsdale\b"),
    ("Geiger", r"\bgeiger\b"),
    ("Argor-Heraeus", r"\bargor[\s-]*heraeus\b"),
    ("Metalor", r"\bmetalor\b"),
    ("Heraeus", r"\bheraeus\b"),
    ("SilverTowne", r"\bsilvertowne\b"),
    ("Apmex", r"\bapmex\b"),
    ("A-Mark", r"\ba[\s-]*mark\b"),
    ("MMTC-PAMP", r"\bmmtc\b"),
    ("Royal Mint", r"\broyal\s*mint\b"),
    ("Umicore", r"\bumicore\b"),
]
#: Series that trade as bullion.
BULLION = [
    "libertad", "silver eagle", "gold eagle", "panda", "perth", "kookaburra", "kangaroo", "lunar", "koala", "maple leaf",
    "britannia", "krugerrand", "philharmonic", "gold buffalo", "platinum eagle", "palladium eagle", "polar bear",
]
#: Order of mint marks and of grade prefixes in a matrix.
MINT_ORDER = ["P", "D", "S", "O", "CC", "W"]
GRADE_ORDER = {"RAW": 0, "MS": 1, "PR": 2, "PF": 2, "SP": 3, "AU": 4, "XF": 5, "EF": 5, "VF": 6, "F": 7, "VG": 8, "G": 9, "AG": 10, "PO": 11}


def brand(title: Column) -> Column:
    return text.first_rule(F.lower(F.coalesce(title, F.lit(""))), BRANDS, "Generic")


def weight_token(weight: Column) -> Column:
    """The weight as search keys write it: fractions by word, whole ounces as ``2oz``; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, ounces in text.OUNCES:
        out = out.when(F.abs(weight - ounces) < 0.01, f"{name} oz")
    whole = F.floor(weight + 0.5)
    return out.when((weight >= 1) & (F.abs(weight - whole) < 0.01), F.concat(whole.cast("string"), F.lit("oz")))


def term_classes(term: Column) -> list[Column]:
    """Boolean columns of a search term: bullion, gold, bar, barber_small (Barber, but no half)."""
    low = F.lower(term)
    small = low.rlike(r"\bbarber\b") & ~low.rlike(r"\bbarber\b.*\bhalf\b")
    return [low.rlike(r"\b(" + "|".join(BULLION) + r")\b").alias("bullion"), low.rlike(r"\bgold\b").alias("gold"), low.rlike(r"\bbar\b").alias("bar"), small.alias("barber_small")]


def rerouted(rows: DataFrame, key: str, title: str) -> DataFrame:
    """``rows`` with ``route``: the key under which a row belongs by the weight in its title. Rows
    stay (``route`` is their key) if a weight is unknown or the same, or the metals differ."""
    found = rows.withColumns({"_own": text.weight(F.col(key)), "_real": text.weight(F.col(title)), "_m": text.metal(F.col(key)), "_n": text.metal(F.col(title))})
    found = found.withColumns({"_old": weight_token(F.col("_own")), "_new": weight_token(F.col("_real"))})
    other = F.coalesce(F.col("_m") != F.col("_n"), F.lit(False))
    moves = ~other & (F.abs(F.col("_own") - F.col("_real")) >= 0.01) & F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return found.select(*rows.columns, F.when(moves, F.replace(F.lower(key), F.col("_old"), F.col("_new"))).otherwise(F.col(key)).alias("route"))


def composite_gate(used: Column, population: Column, confidence: Column, most: int = 35) -> tuple[Column, Column]:
    """Whether other years' sales may stand in (not for populations below 50), and the confidence
    then, ``most`` at the most."""
    allowed = F.coalesce(used, F.lit(False)) & ~F.coalesce(population < 50, F.lit(False))
    return allowed, F.when(allowed, F.least(confidence, F.lit(most))).otherwise(confidence)


def mint_rank(mint: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MINT_ORDER)), mint), F.lit(0)) - 1, F.lit(99)).cast("int")


def grade_rank(grade: Column) -> Column:
    """A struct that sorts grades: raw first, prefixes in their order, high numbers first."""
    prefix, number = F.regexp_replace(grade, "[0-9]+[+]?$", ""), F.regexp_extract(grade, "([0-9]+)", 1).try_cast("int")
    order = F.create_map(*[F.lit(x) for item in GRADE_ORDER.items() for x in item])
    return F.struct(F.coalesce(F.try_element_at(order, prefix), F.lit(99)).alias("kind"), (-F.coalesce(number, F.lit(0))).alias("number"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of a sorted listing, counted from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def sampled(df: DataFrame, key: str, share: float, seed: int, golden: DataFrame | None = None) -> DataFrame:
    """About ``share`` of the keys, by a seeded hash, so that any engine and any layout draw the
    same ones; rows whose key is in ``golden`` always come along."""
    print_ = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    drawn = F.conv(F.substring(print_, 1, 6), 16, 10).cast("bigint") < int(share * (1 << 24))
    if golden is None:
        return df.where(drawn)
    sure = golden.select(key).distinct().withColumn("_sure", F.lit(True))
    return df.join(sure, key, "left").where(drawn | F.col("_sure").isNotNull()).drop("_sure")


def parity(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, a, b, delta (per cent of a) and bucket of two routes' values: match (1 %), near (5 %), drift, or missing."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    delta = F.when(F.col("a") > 0, F.abs(F.col("b") - F.col("a")) / F.col("a") * 100)
    bucket = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(delta <= 1, "match").when(delta <= 5, "near").otherwise("drift")
    return both.select(*keys, "a", "b", delta.alias("delta"), bucket.alias("bucket"))


def chosen(first: DataFrame, second: DataFrame, keys: list[str], score: str) -> DataFrame:
    """For each key the candidate of the better score; of equal ones the first look-up's."""
    both = first.withColumn("lookup", F.lit(0)).unionByName(second.withColumn("lookup", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), F.struct(score, -F.col("lookup"))).alias("_best"))
    return best.select(*keys, "_best.*")


def missing_cells(keys: DataFrame, grades: DataFrame, existing: DataFrame) -> DataFrame:
    """The cross product of two dimensions without what exists: data sets to create."""
    return keys.crossJoin(grades).join(existing, [*keys.columns, *grades.columns], "left_anti")


def stamped(df: DataFrame, **versions: str) -> DataFrame:
    """``df`` with its versions and ``version``, the first twelve digits of their SHA-256."""
    joined = "|".join(f"{k}={versions[k]}" for k in sorted(versions))
    return df.withColumns({**{k: F.lit(v) for k, v in versions.items()}, "version": F.substring(F.sha2(F.lit(joined).cast("binary"), 256), 1, 12)})


def masked(comps: Column, shown: str = "market") -> Column:
    """An array of structs whose ``source`` is masked and whose ``cohort`` flag is gone."""
    return F.transform(comps, lambda c: c.withField("source", F.lit(shown)).dropFields("cohort"))


def with_proof(term: Column, proof: Column) -> Column:
    """A search term that says proof, if one is wanted and it doesn't yet."""
    return F.when(proof & ~F.lower(term).rlike(r"\bproof\b"), F.concat(term, F.lit(" proof"))).otherwise(term)


def normalised_series(items: DataFrame, series: DataFrame) -> DataFrame:
    """item_id and the ``series`` it means, with the ``step`` that found it (see ``ladders.series_names``)."""
    return items.join(ladders.series_names(items, series), "name").select("item_id", "series", "step")


def contamination(rows: DataFrame, keys: list[str], title: str, value: str, groups: dict[str, str]) -> DataFrame:
    """keys, a count of titles for each pattern group, before and after (medians with and without
    flagged titles) and shift in per cent."""
    low = F.lower(title)
    flags = {name: F.coalesce(low.rlike(pattern), F.lit(False)) for name, pattern in groups.items()}
    clean = ~F.greatest(*flags.values())
    out = rows.groupBy(*keys).agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()], F.percentile(value, F.lit(0.5)).alias("before"), F.percentile(F.when(clean, F.col(value)), F.lit(0.5)).alias("after"))
    return out.withColumn("shift", F.floor((F.col("after") - F.col("before")) / F.col("before") * 1000 + 0.5) / 10)


def last_months(df: DataFrame, when: str, as_of: Column, months: int = 36) -> DataFrame:
    """Rows of the last ``months`` months up to ``as_of``."""
    return df.where((F.col(when) > F.add_months(as_of, -months)) & (F.col(when) <= as_of))


def numbered(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """``df`` with ``nth`` in its group; groups are small (cells of a matrix)."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
