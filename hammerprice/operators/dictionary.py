"""Which names a text holds, found by an inverted index of character grams.

A name inside a text shares every gram with it. Each name is posted once, under the one of
its grams that the fewest texts have; texts meet the postings by equality, and only pairs
that met are compared. No pair is met twice, no name is compared with every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: Column | int) -> Column:
    """The distinct substrings of ``size`` characters; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size))).otherwise(F.array().cast("array<string>")))


def held_names(texts: DataFrame, names: DataFrame, text: str, name: str, size: int = 3) -> DataFrame:
    """``text`` and ``name`` for each distinct text and each distinct name inside it, letter by letter.

    Nulls and empty names are in nothing. Names shorter than ``size`` are posted whole."""
    t = texts.select(text).where(F.col(text).isNotNull()).distinct()
    n = names.select(name).where(F.length(name) > 0).distinct()
    own = n.select(name, F.explode(grams(F.col(name), F.least(F.length(name), F.lit(size)))).alias("_gram"))
    lengths = sorted(r[0] for r in own.select(F.length("_gram")).distinct().collect())  # as many as ``size``
    if not lengths:
        return t.join(n, F.lit(False))
    each = t.select(text, F.explode(F.array_distinct(F.concat(*[grams(F.col(text), k) for k in lengths]))).alias("_gram"))
    known = own.select("_gram").distinct()
    counts = each.join(known, "_gram").groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    posted = own.join(counts, "_gram", "left").groupBy(name).agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    return each.join(posted, "_gram").where(F.contains(F.col(text), F.col(name))).select(text, name)


def first_held(texts: DataFrame, names: DataFrame, text: str, name: str, order: str, size: int = 3) -> DataFrame:
    """Each distinct text that holds a name of ``names`` (name, order, ...), with the columns of the one that comes first."""
    columns = [c for c in names.columns if c != name]
    met = held_names(texts, names, text, name, size).join(names, name)
    return met.groupBy(text).agg(F.min_by(F.struct(name, *columns), order).alias("_first")).select(text, "_first.*")


def either_way(left: DataFrame, right: DataFrame, a: str, b: str, size: int = 3) -> DataFrame:
    """``a`` and ``b`` for each distinct pair of which one holds the other."""
    inside = held_names(right, left, b, a, size).select(a, b)
    return held_names(left, right, a, b, size).union(inside).distinct()
