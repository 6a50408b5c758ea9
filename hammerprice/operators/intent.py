"""What a search asks for, what a key is made of, and keys that no data stands behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Parts of names by which series and compositions are told.
BULLION = [
    "libertad", "silver eagle", "gold eagle", "maple leaf", "britannia", "philharmonic", "krugerrand", "kangaroo", "kookaburra", "panda",
    "gold buffalo", "platinum eagle", "palladium eagle", "lunar", "polar bear", "koala", "swan", "emu", "wedge-tailed eagle",
    "wedge tailed eagle", "quokka", "super pit", "wildlife", "birds of prey", "predator", "creatures of the north",
]
SILVER_COINS = [
    "morgan", "peace dollar", "peace silver dollar", "walking liberty", "seated liberty", "barber half", "barber quarter", "barber dime",
    "franklin half", "mercury dime", "roosevelt dime", "washington quarter", "standing liberty quarter", "kennedy half", "trade dollar",
    "bust half", "bust dollar", "draped bust", "flowing hair", "capped bust",
]
GOLD_COINS = [
    "liberty gold", "liberty eagle", "liberty half eagle", "liberty quarter eagle", "indian head gold", "indian gold", "saint-gaudens",
    "saint gaudens", "double eagle", "gold dollar",
]
BASE_COINS = [
    "indian head cent", "lincoln", "shield nickel", "jefferson nickel", "liberty nickel", "liberty v nickel", "buffalo nickel", "wheat cent",
    "flying eagle", "large cent", "half cent", "two cent", "three cent", "eisenhower", "susan b anthony", "sacagawea", "jefferson war nickel",
]
BARS = ["silver bar", "gold bar", "platinum bar", "silver round", "gold round"]
SETS = ["proof set", "mint set", "prestige set", "us mint uncirculated set"]
JUNK = ["junk silver"]
JUNK_BY_FACE = ["90 silver dimes", "90 silver quarters", "90 silver half dollars"]
PRECIOUS = ["gold", "silver", "platinum", "palladium"]
#: Metals of bullion whose name says none; silver otherwise.
IMPLIED = [("gold", "gold eagle|gold buffalo|krugerrand"), ("platinum", "platinum eagle"), ("palladium", "palladium eagle")]
#: Countries and their adjectives.
ADJECTIVES = {"mexico": "mexican", "canada": "canadian", "china": "chinese", "australia": "australian", "austria": "austrian", "britain": "british"}


def _holds(low: Column, names: list[str]) -> Column:
    return low.rlike("|".join(names))


def _named_metal(low: Column, implied: bool) -> Column:
    rules = [(m, rf"\b{m}\b") for m in PRECIOUS]
    return text.first_rule(low, rules + IMPLIED if implied else rules, "silver" if implied else None)


def metal_profile(query: Column) -> Column:
    """Struct (is_metal, metal) of a search; words after a minus sign don't count, null has no metal."""
    low = F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), r"(^|\s)-[a-zA-Z]+", " "))
    found = F.when(_holds(low, BULLION), _named_metal(low, True)).when(_holds(low, GOLD_COINS), "gold").when(_holds(low, SILVER_COINS), "silver")
    metal = found.otherwise(_named_metal(low, False))
    return F.struct(metal.isNotNull().alias("is_metal"), metal.alias("metal"))


def composition(key: Column) -> Column:
    """The class of a dataset key: junk silver, bars, sets, bullion by weight and finish, coins by metal; else unknown."""
    low = F.lower(F.coalesce(key, F.lit("")))
    small = F.when(_named_metal(low, True) == "gold", "bullion-fractional-gold").otherwise("bullion-fractional-silver")
    bullion = F.when(low.rlike(r"\b(half|quarter|tenth|twentieth)\s*oz\b"), small).when(low.rlike(r"\b([2-9]|[1-9][0-9]+)oz\b"), "bullion-multioz")
    bullion = bullion.when(low.rlike(r"\bproof\b"), "bullion-proof").otherwise("bullion")
    out = F.when(_holds(low, JUNK), "junk-silver").when(_holds(low, JUNK_BY_FACE), "junk-silver-denom").when(_holds(low, BARS), "bar").when(_holds(low, SETS), "set")
    out = out.when(_holds(low, BULLION), bullion).when(_holds(low, GOLD_COINS) | low.rlike("indian.*eagle") & ~low.contains("cent"), "gold-numismatic")
    out = out.when(_holds(low, SILVER_COINS) | low.contains("war nickel"), "silver-numismatic").when(_holds(low, BASE_COINS), "base-metal")
    return out.otherwise("unknown")


def graded(key: Column) -> Column:
    """``graded`` for a key with a grade, else ``raw``."""
    return F.when(F.coalesce(F.lower(key).rlike(r"\b(ms|pr|pf|au|vf|xf|ef)\s*[0-9]{1,2}\b"), F.lit(False)), "graded").otherwise("raw")


def form(query: Column) -> Column:
    """bar, round or coin."""
    return text.first_rule(F.lower(query), [("bar", r"\bbar\b"), ("round", r"\bround\b")], "coin")


def merged(form_: Column, lookup: Column, parsed: Column, is_set: Column, flag: Column) -> Column:
    """One intent of three structs (grade, finish, designation, is_proof): what the form says, then the
    look-up, then the text; of designations the look-up's goes first. Empty strings say nothing, null
    structs neither. A set has no grade and is no proof, else any sign of a proof counts."""

    def first(name: str, *given: Column) -> Column:
        return F.coalesce(*[F.nullif(g[name].cast("string"), F.lit("")) for g in given])

    no = F.lit(False)
    is_set = F.coalesce(is_set, no)
    grade = F.when(~is_set, first("grade", form_, lookup, parsed))
    finish = F.nullif(F.trim(first("finish", form_, parsed)), F.lit(""))
    designation = first("designation", lookup, form_, parsed)
    struck = [F.lower(x).rlike("^p[rf].*[0-9]") for x in (grade, designation)]
    signs = [flag, form_["is_proof"], F.lower(finish).rlike(r"\bproof\b"), F.lower(grade) == "proof", parsed["grade"] == "Proof", *struck]
    proof = ~is_set & F.greatest(*[F.coalesce(s, no) for s in signs])
    return F.struct(grade.alias("grade"), finish.alias("finish"), proof.alias("is_proof"), designation.alias("designation"))


def bulk_items(line: Column, longest: int = 300) -> Column:
    """The items of a JSON array, bare strings or objects with query, name or coin: an array of (query,
    too_long, qty). Queries are cut at ``longest``, quantities that are none or zero are one; what is no array gives null.
    A string that begins with a brace is taken for an object."""

    def item(x: Column) -> Column:
        names = [F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in ("query", "name", "coin")]
        query = F.when(x.startswith("{"), F.coalesce(*names, F.lit(""))).otherwise(x)
        counts = [F.nullif(F.get_json_object(x, f"$.{n}").try_cast("int"), F.lit(0)) for n in ("qty", "quantity")]
        return F.struct(F.substring(query, 1, longest).alias("query"), (F.length(query) > longest).alias("too_long"), F.coalesce(*counts, F.lit(1)).alias("qty"))

    return F.transform(F.from_json(line, "array<string>"), item)


_TIMES = ["deep_at", "page1_at", "last_refresh"]


def _merged_keys(meta: DataFrame, group: Column, canonical: Callable[[Column], Column]) -> DataFrame:
    """One row for each group: its own canonical key goes first, then the one with the most rows."""
    key = F.col("key")
    rank = F.struct((key != canonical(key)).alias("other"), (-F.coalesce("n", F.lit(0))).alias("few"), key)
    held = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in _TIMES]
    rows = meta.withColumns({"_group": group, "_rank": rank}).groupBy("_group")
    return rows.agg(F.min_by("key", "_rank").alias("key"), *held, F.max("newest").alias("newest"), F.min("oldest").alias("oldest"), F.max("n").alias("n")).drop("_group")


def word_set(key: Column) -> Column:
    """The sorted words of a key, its adjectives as countries."""
    low = F.lower(key)
    for country, adjective in ADJECTIVES.items():
        low = F.regexp_replace(low, rf"\b{adjective}\b", country)
    return F.array_join(F.array_sort(text.tokens(F.regexp_replace(low, r"\bgreat britain\b", "britain"))), " ")


def pruned(meta: DataFrame, canonical: Callable[[Column], Column]) -> DataFrame:
    """Keys that data stands behind: key, deep_at, page1_at, last_refresh, newest, oldest, n.

    Keys of one canonical form are merged, then keys of one set of words. Of the keys without rows
    that are left, those that another spelling (country before weight, mint mark after a blank, no
    weight) leads to a key with rows give it the times that it lacks; the others go. Ties go to the
    first key in the alphabet."""
    rows = _merged_keys(meta, canonical(F.col("key")), canonical)
    rows = _merged_keys(rows, word_set(F.col("key")), canonical)
    real, ghosts = rows.where("n > 0"), rows.where("n is null or n <= 0")
    parts = F.split("key", " ")
    adjective = F.try_element_at(F.create_map(*[F.lit(x) for item in ADJECTIVES.items() for x in item]), F.get(parts, F.lit(1)))
    rest = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(0))), " ")
    turned = F.when((F.size(parts) >= 5) & adjective.isNotNull(), F.concat_ws(" ", F.get(parts, F.lit(0)), adjective, F.get(parts, F.lit(3)), rest, F.get(parts, F.lit(2))))
    marked = F.when(F.col("key").rlike("^[0-9]{4} (cc|d|s|o|w|p) ."), F.regexp_replace("key", "^([0-9]{4}) ", "$1-"))
    weighed = F.when(~F.col("key").contains("oz"), F.concat("key", F.lit(" 1oz")))
    spelt = ghosts.select("key", *_TIMES, F.posexplode(F.array(turned, marked, weighed)).alias("step", "to")).where("to is not null")
    met = spelt.join(real.select(F.col("key").alias("to")), "to").groupBy("key").agg(F.min_by(F.struct("to", *_TIMES), "step").alias("g"))
    given = met.groupBy(F.col("g.to").alias("key")).agg(*[F.min_by(f"g.{c}", F.when(F.col(f"g.{c}").isNotNull(), F.col("key"))).alias(f"_{c}") for c in _TIMES])
    filled = [F.coalesce(c, f"_{c}").alias(c) for c in _TIMES]
    return real.join(given, "key", "left").select("key", *filled, "newest", "oldest", "n")
