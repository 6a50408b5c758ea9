"""Ordered rules that remove rows, each row counted under the first that it fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import variants

Rule = tuple[str, Column]


def removed_by(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with the name of the first rule that removes it (null: kept). A rule that is
    null - something is unknown - removes nothing. One pass for all rules."""
    case = F.when(F.lit(False), F.lit(""))
    for name, fails in rules:
        case = case.when(F.coalesce(fails, F.lit(False)), F.lit(name))
    return df.withColumn("removed_by", case)


def removal_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.coalesce("removed_by", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("rows"))


def listing_rules(title: Column, wanted: dict[str, Column]) -> list[Rule]:
    """Rules for a listing's title and numbers against what is wanted, in their order. Known
    fields of ``wanted``: score, least_score, total_usd, metal, weight, year, tolerance, grade, mint,
    denomination, price, spot, query (the search's text), series, label ("Type 1", "Type 2"), brand
    (of a bar), bar_brand and bar_series with found_brand and found_series (as detected in the
    title), exclusions (array), and the booleans roll, set, proof, pcgs_only, grade_only. Only
    rules whose fields are given apply; without ``query`` no finish family is asked for."""
    low = F.lower(title)
    rules: list[Rule] = []

    def add(name: str, needs: str, fails) -> None:
        if all(n in wanted for n in needs.split()):
            rules.append((name, fails()))

    w = wanted
    family = variants.requested_family(w["query"]) if "query" in w else F.lit(None).cast("string")
    proof = F.coalesce(w.get("proof", F.lit(False)), F.lit(False))
    if "query" in w:
        proof = proof | F.coalesce(F.lower(w["query"]).rlike(r"\bproof\b"), F.lit(False))
    finish = variants.variant_mismatch(title, family, proof)
    add("lowRelevance", "score", lambda: w["score"] < w.get("least_score", F.lit(20)))
    rules.append(("denied", F.when(w.get("roll", F.lit(False)), text.denied(title, True)).otherwise(text.denied(title))))
    add("nonBullionDenom", "weight", lambda: w["weight"].isNotNull() & variants.small_change(title))
    add("notSet", "set", lambda: w["set"] & ~low.rlike(r"\bset\b"))
    add("notRoll", "roll", lambda: w["roll"] & ~low.rlike(text.ROLLS))
    add("notProof", "proof", lambda: w["proof"] & family.isNull() & ~low.rlike(r"\bproof\b"))
    add("wrongBrand", "brand", lambda: variants.lacks_words(title, w["brand"]))
    add("barBrandMismatch", "bar_brand bar_series found_brand", lambda: w["found_brand"] != w["bar_brand"])
    add("barSeriesMismatch", "bar_brand bar_series found_series", lambda: w["found_series"] != w["bar_series"])
    add("excluded", "exclusions", lambda: F.exists(w["exclusions"], lambda x: low.contains(x)))
    add("nonUsd", "total_usd", lambda: w["total_usd"].isNull())
    opposite = reduce(lambda rest, item: F.when(w["metal"] == item[0], low.rlike(item[1])).otherwise(rest), text.OPPOSITES.items(), F.lit(False)) if "metal" in w else F.lit(False)
    add("metalMismatch", "metal", lambda: (text.title_metal(title) != w["metal"]) | (text.title_metal(title).isNotNull() & opposite))
    add("compositionMismatch", "series year", lambda: variants.composition_mismatch(title, F.concat_ws(" ", w["series"], w["query"]) if "query" in w else w["series"], w["year"]))
    add("weightMismatch", "weight", lambda: F.abs(text.weight(title) - w["weight"]) / F.greatest(text.weight(title), w["weight"]) >= 0.05)
    add("meltSanity", "weight price spot", lambda: text.weight(title).isNull() & (w["price"] > F.greatest(w["spot"] * w["weight"] * 5, F.lit(50.0))))
    add("yearMismatch", "year", lambda: (F.size(text.years(title)) > 0) & F.forall(text.years(title), lambda y: F.abs(y - w["year"]) > w.get("tolerance", F.lit(1))))
    add("meltFloor", "weight price spot", lambda: (w["weight"] >= 1) & (w["price"] < w["spot"] * w["weight"] * 0.4))
    rules.append(("variantMismatch", finish == "variantMismatch"))
    rules.append(("variantWrongColor", finish == "variantWrongColor"))
    add("typeMismatch", "label", lambda: F.when(w["label"] == "Type 1", low.rlike(r"\btype\s*2\b")).when(w["label"] == "Type 2", low.rlike(r"\btype\s*1\b")))
    add("mintMismatch", "mint", lambda: (F.size(text.stated_mints(title)) > 0) & ~F.array_contains(text.stated_mints(title), F.upper(w["mint"])))
    add("denomMismatch", "denomination", lambda: text.denomination(title) != w["denomination"])
    add("seriesConflict", "series", lambda: variants.series_conflict(w["series"], title))
    number = F.nullif(F.regexp_extract(w["grade"], "([0-9]+)", 1).try_cast("int"), F.lit(0)) if "grade" in w else F.lit(None)
    add("gradeNumMismatch", "grade", lambda: (F.size(text.grade_numbers(title)) > 0) & ~F.array_contains(text.grade_numbers(title), number))
    add("pcgsOnly", "pcgs_only", lambda: w["pcgs_only"] & ~low.rlike(r"\bpcgs\b"))
    add("gradeOnly", "grade_only grade", lambda: w["grade_only"] & variants.lacks_words(title, w["grade"]))
    return rules


def relevance(title: Column, year: Column | None = None, metal: Column | None = None, grade: Column | None = None, weight: Column | None = None, words: Column | None = None) -> Column:
    """Match score of a title: 50, plus and minus points for what is wanted and known, 100 at most."""
    s = F.lit(50)
    low = F.lower(title)
    if year is not None:
        there = text.years(title)
        s = s + F.when(year.isNull() | (F.size(there) == 0), 0).when(F.array_contains(there, year), 15).otherwise(-30)
    if metal is not None:
        s = s + F.when(text.metal(title) == metal, 10).when(text.metal(title) != metal, -30).otherwise(0)
    if grade is not None:
        s = s + F.when(text.grade(title) == grade, 15).when(text.grade(title) != grade, -20).otherwise(0)
    if weight is not None:
        off = F.abs(text.weight(title) - weight) / F.greatest(text.weight(title), weight)
        s = s + F.when(off < 0.05, 25).when(off < 0.2, -15).when(off.isNotNull(), -35).otherwise(0)
    if words is not None:
        there = F.size(F.filter(words, lambda x: low.contains(x))) / F.size(words)
        s = s + F.when(there >= 0.6, 10).when(there == 0, -25).otherwise(0)
    s = s + F.when(low.rlike(r"\b(pcgs|ngc)\b"), 5).otherwise(0)
    return F.least(F.lit(100), s)


def quality(score: Column) -> Column:
    return F.when(score >= 85, "exact").when(score >= 65, "close").otherwise("loose")
