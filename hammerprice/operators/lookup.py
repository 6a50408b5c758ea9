"""As-of, range, rule and token joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, series: DataFrame, keys: list[str], when: str, day: str, value: str, days: int = 7) -> DataFrame:
    """``left`` with the series' ``value`` on that day and its ``matched_day``: the latest one up
    to it, or, only if there is none at all, the earliest later one; null if over ``days`` away.

    The series has one row per key and day. Each of its rows is spread over the days that
    it answers for, ``days`` + 1 at most (and ``days`` more before the first), so the large
    side is met by an equi-join and never sorted into groups."""
    at = F.to_date(day)
    w = Window.partitionBy(*keys).orderBy("_d")
    rows = series.select(*keys, at.alias("_d"), F.col(value)).withColumn("_next", F.lead("_d").over(w)).withColumn("_nth", F.row_number().over(w))
    last = F.least(F.date_add("_d", days), F.coalesce(F.date_sub("_next", 1), F.date_add("_d", days)))
    start = F.when(F.col("_nth") == 1, F.date_sub("_d", days)).otherwise(F.col("_d"))
    dense = rows.select(*keys, F.explode(F.sequence(start, last)).alias("_day"), F.col(value), F.col("_d").alias("matched_day"))
    return left.withColumn("_day", F.to_date(when)).join(dense, [*keys, "_day"], "left").drop("_day")


def first_rule_join(df: DataFrame, rules: list[tuple[Column, dict[str, object]]], names: list[str]) -> DataFrame:
    """``df`` with the outputs of the first rule whose condition holds (null without one).

    Rules are a fixed, ordered list, so they become one CASE expression and no join."""
    out = df
    for name in names:
        case = F.when(F.lit(False), F.lit(None))
        for condition, values in rules:
            case = case.when(condition, F.lit(values.get(name)))
        out = out.withColumn(name, case)
    return out


def token_matches(queries: DataFrame, keys: DataFrame, strong: float = 0.65, both: float = 0.55, block: str | None = None) -> DataFrame:
    """Pairs of ``queries`` (query_id, words) and ``keys`` (key_id, words) that share enough words.

    Words are distinct and have two letters at least. An inverted index over words finds
    the pairs. Words have one order, rarest first; of a row only the first are posted, as many
    as the strong side's gate allows to miss plus one, so frequent words rarely meet. Both gates
    together give the least number of words that two rows of given sizes share, so the first
    word that they share stands early in both: other meetings are dropped within the join.
    Shared words are counted then exactly. forward and reverse are shares of the key's and the
    query's words; a pair needs ``strong`` on its better side and more than ``both`` on average.

    Rows whose column ``block`` (of both sides) differs never match, a null fits all: words are posted under it."""
    words = F.filter(F.array_distinct("words"), lambda w: F.length(w) > 1)
    q, k = (d.withColumn("words", words).where(F.size("words") > 0) for d in (queries, keys))
    each = [d.select(name, F.size("words").alias("n"), F.explode("words").alias("word")) for d, name in ((q, "query_id"), (k, "key_id"))]
    counts = each[0].select("word").unionAll(each[1].select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def ranked(d: DataFrame, name: str, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(name).orderBy("df", "word"))
        return d.join(counts, "word").select(name, "word", F.col("n").alias(f"{side}n"), nth.alias(f"{side}nth"))

    left, right = ranked(each[0], "query_id", "q"), ranked(each[1], "key_id", "k")
    if block:
        # A dated query, say, meets the keys of its year and the undated ones, an undated query meets all.
        own = F.concat(F.lit("="), F.col(block).cast("string"))
        under = [F.when(own.isNull(), F.array(F.lit("any"))).otherwise(F.array(own, F.lit("none"))), F.array(F.lit("any"), F.coalesce(own, F.lit("none")))]
        left, right = (r.join(d.select(name, F.explode(u).alias("under")), name) for r, d, name, u in ((left, q, "query_id", under[0]), (right, k, "key_id", under[1])))
    meet = ["word", "under"] if block else ["word"]
    a, b = F.col("qn"), F.col("kn")
    least = F.greatest(F.ceil(2 * both * a * b / (a + b) - 1e-9), F.ceil(strong * F.least(a, b) - 1e-9))
    early = (F.col("qnth") <= a - least + 1) & (F.col("knth") <= b - least + 1)
    rare = [d.where(F.col(f"{s}nth") <= F.col(f"{s}n") - F.ceil(F.col(f"{s}n") * strong - 1e-9) + 1) for d, s in ((left, "q"), (right, "k"))]
    pairs = rare[0].join(right, meet).where(early).select("query_id", "key_id")
    pairs = pairs.union(rare[1].join(left, meet).where(early).select("query_id", "key_id")).distinct()
    full = pairs.join(q.select("query_id", F.col("words").alias("qw")), "query_id").join(k.select("key_id", F.col("words").alias("kw")), "key_id")
    hits = F.size(F.array_intersect("qw", "kw"))
    full = full.select("query_id", "key_id", hits.alias("hits"), (hits / F.size("kw")).alias("forward"), (hits / F.size("qw")).alias("reverse"))
    mean = (F.col("forward") + F.col("reverse")) / 2
    return full.withColumn("combined", mean).where((F.greatest("forward", "reverse") >= strong) & (F.col("combined") > both))
