"""A crossover pilot of two profiles: whether its passes came in the order that was set, and which profile is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The profiles, and the order of a pilot's passes (0: baseline, 1: tuned).
BASELINE, TUNED = "baseline", "normal-tuned"
SEQUENCE = [0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 1, 0]
OUTCOMES = ["succeeded", "failed", "empty", "unknown"]
COUNTS = ["attempted", *OUTCOMES, "challenges", "no_export"]


def problem(row: dict[str, Column]) -> Column:
    """The first thing that makes a pass no part of a pilot; null for a good one.

    ``row``: state_before, requested, effective, duration and ``COUNTS``."""
    known = F.lit(True)
    positive = F.lit(True)
    for name in [*COUNTS, "duration"]:
        known &= row[name].isNotNull() & ~F.isnan(row[name].cast("double"))
        positive &= row[name] >= 0
    total = sum((row[o] for o in OUTCOMES), F.lit(0))
    profile = row["effective"].isin(BASELINE, TUNED) & (row["requested"] == row["effective"])
    out = F.when(~F.coalesce(row["state_before"] == "Normal", F.lit(False)), "not normal").when(~known, "missing number")
    out = out.when((row["attempted"] <= 0) | (row["duration"] <= 0), "nothing attempted").when(~positive, "negative number").when(total != row["attempted"], "outcomes don't sum up")
    return out.when(~F.coalesce(profile, F.lit(False)), "wrong profile")


def report(passes: DataFrame, at: str, same: list[str]) -> DataFrame:
    """A row for each ``pilot_id``: passes, problems, the sequence check, both profiles' rates, and what they recommend.

    ``passes`` has pilot_id, run_id, state_before, state_after, requested, effective, duration,
    ``COUNTS`` and the columns ``same``, which must not change within a pilot. In the order of
    ``at`` and run_id the first twelve good passes are the pilot; ``break_at`` is the first place
    that differs from the sequence (null: none, one more than the passes: the end is missing);
    later passes are ``surplus`` and a problem, as bad ones are. Recommendations: insufficient-data
    with any problem, break or change of ``same``; reject after a challenge or cooldown; adopt if
    seconds an attempt fell by 10 per cent or more and no rate is worse; else retain-baseline."""
    row = {c: F.col(c) for c in ("state_before", "requested", "effective", "duration", *COUNTS)}
    judged = passes.withColumn("_bad", problem(row))
    good = judged.where("_bad IS NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("pilot_id").orderBy(at, "run_id")))
    tuned = (F.col("effective") == TUNED).cast("int")
    right = tuned == F.get(F.array(*map(F.lit, SEQUENCE)), F.col("_nth") - 1)
    used = good.where(F.col("_nth") <= len(SEQUENCE)).withColumns({"_right": right, "_tuned": tuned})
    extra = judged.groupBy("pilot_id").agg(F.count("_bad").alias("problems"), F.count_if(F.col("_bad").isNull()).alias("_good"))

    def of(which: int, x: Column) -> Column:
        return F.sum(F.when(F.col("_tuned") == which, x))

    aggs = {"passes": F.count(F.lit(1)), "_wrong": F.min(F.when(~F.col("_right"), F.col("_nth"))), "_mixed": F.lit(False)}
    for name in same:
        aggs["_mixed"] = aggs["_mixed"] | (F.min(name) != F.max(name)) | (F.count(name) < F.count(F.lit(1)))
    for which, short in ((0, "base"), (1, "tuned")):
        n = of(which, F.col("attempted"))
        rates = {"pace": of(which, F.col("duration")), "success": of(which, F.col("succeeded")), "failure": of(which, F.col("failed")), "unknown": of(which, F.col("unknown")), "no_export": of(which, F.col("no_export")), "challenge": of(which, F.col("challenges"))}
        aggs |= {f"{short}_{k}": v / n for k, v in rates.items()}
        there = of(which, F.lit(1))
        aggs |= {f"{short}_elevated": of(which, (F.col("state_after") == "Elevated").cast("int")) / there, f"{short}_cooldown": of(which, (F.col("state_after") == "Cooldown").cast("int")) / there}
    found = used.groupBy("pilot_id").agg(*[v.alias(k) for k, v in aggs.items()])
    out = extra.join(found, "pilot_id", "left").na.fill(0, ["passes"])
    breaks = F.coalesce("_wrong", F.when(F.col("passes") < len(SEQUENCE), F.col("passes") + 1))
    surplus = F.greatest(F.col("_good") - len(SEQUENCE), F.lit(0))
    faster = F.floor((F.col("base_pace") - F.col("tuned_pace")) / F.col("base_pace") * 10_000 + 0.5) / 100
    no_worse = F.col("tuned_success") >= F.col("base_success")
    for name in ("failure", "unknown", "no_export", "challenge", "elevated", "cooldown"):
        no_worse &= F.col(f"tuned_{name}") <= F.col(f"base_{name}")
    hard = F.greatest("base_challenge", "tuned_challenge", "base_cooldown", "tuned_cooldown") > 0
    mixed = F.coalesce("_mixed", F.lit(False))
    ready = breaks.isNull() & (surplus == 0) & (F.col("problems") == 0) & ~mixed
    verdict = F.when(~ready, "insufficient-data").when(hard, "reject").when((faster >= 10) & no_worse, "adopt").otherwise("retain-baseline")
    columns = {"passes": F.col("passes"), "problems": F.col("problems"), "surplus": surplus, "break_at": breaks, "mixed": mixed, "faster_pct": faster, "recommendation": verdict}
    return out.select("pilot_id", *[c.alias(k) for k, c in columns.items()])
