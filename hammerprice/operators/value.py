"""Fair values from sold prices, reference prices and guides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import blend, clamp, money
from . import robust

#: Weights of sold, guide, auction and wholesale prices by tier of the grade, and for raw items.
CERTIFIED = {"low": (0.65, 0.10, 0.05, 0.20), "mid": (0.55, 0.15, 0.10, 0.20), "high": (0.30, 0.20, 0.25, 0.25)}
RAW = (0.70, 0.10, 0.20)
#: Comps at least, weight of the wholesale price beside spot and premium.
WHOLESALE = [(20, 0.05), (10, 0.10), (5, 0.15), (0, 0.20)]
#: Fixed value: years on either side of a thin year that stand in for it.
YEARS = 3


def pool_comps(comps: DataFrame, wanted: Column, guide: Column) -> DataFrame:
    """Of the comps of each query (query_id, pool, sold) those of the wanted pool. A graded
    query without any sold graded comp takes raw ones, if ten sold ones are there and no
    guide price is known; ``fallback`` marks it. Other pools never stand in for each other."""
    sold = F.coalesce("sold", F.lit(True))
    count = comps.groupBy("query_id").agg(F.count_if((F.col("pool") == "graded") & sold).alias("_g"), F.count_if((F.col("pool") == "raw") & sold).alias("_r"))
    rows = comps.join(count, "query_id").withColumn("fallback", (wanted == "graded") & (F.col("_g") == 0) & (F.col("_r") >= 10) & guide.isNull())
    return rows.where(F.col("pool") == F.when(F.col("fallback"), "raw").otherwise(wanted)).drop("_g", "_r")


def sold_prices(comps: DataFrame, as_of: Column, half_life: Column | float) -> DataFrame:
    """query_id, sold_median (weighted by recency and score), plain_median, n, sd, p25, sold_share."""
    rows = comps.where("total_usd is not null").withColumn("_w", robust.recency_weight(F.col("sold_date"), as_of, half_life, F.col("match_score")))
    value = robust.weighted_median(rows, ["query_id"], "total_usd", "_w").withColumnRenamed("weighted_median", "sold_median")
    aggs = {"plain_median": F.median("total_usd"), "n": F.count(F.lit(1)), "sd": F.coalesce(F.stddev_samp("total_usd"), F.lit(0.0)), "p25": F.percentile("total_usd", F.lit(0.25)), "sold_share": F.avg(F.coalesce("sold", F.lit(True)).cast("double"))}
    return value.join(rows.groupBy("query_id").agg(*[a.alias(k) for k, a in aggs.items()]), "query_id")


def fair_value(df: DataFrame, doubt: bool = True) -> DataFrame:
    """``df`` with ``fmv`` (money), ``method``, ``label``, ``range_low`` and ``range_high``.

    Columns: sold_median, n, sd, sold_share; spot (melt value of the whole item), wholesale,
    guide, auction; bullion, proof, certified (boolean), tier (low, mid, high), appeal (1 to
    2, null: 1). Bullion that is no proof is spot plus the premium that sales show (-5 % to
    100 %, to 40 % above 500), drawn a little to the wholesale price; without sales it leans
    on wholesale (if that is 80 % of spot) or is spot. All else is a blend of the sources
    that are there. Without any source everything is null and the label is metal-only.
    With ``doubt`` the wholesale price of bullion that is absurdly below spot or sales is not used."""
    sold, spot, n = F.col("sold_median"), F.col("spot"), F.coalesce("n", F.lit(0))
    by_spot = F.coalesce(F.col("bullion") & ~F.col("proof") & (spot > 0), F.lit(False))
    absurd = F.col("bullion") & (F.coalesce(F.col("wholesale") < spot * 0.01, F.lit(False)) | F.coalesce(F.col("wholesale") < sold * 0.05, F.lit(False)))
    wholesale = F.when(~absurd, F.col("wholesale")) if doubt else F.col("wholesale")
    most = F.when(spot > 500, 0.4).otherwise(1.0)
    premium = spot * (1 + F.greatest(F.lit(-0.05), F.least((sold - spot) / spot, most)))
    share = reduce(lambda rest, step: F.when(n >= step[0], step[1]).otherwise(rest), reversed(WHOLESALE), F.lit(0.0))
    premium = F.when(wholesale.isNotNull(), premium * (1 - share) + wholesale * share).otherwise(premium)
    anchored = wholesale >= spot * 0.8
    sources = (sold, F.col("guide"), F.col("auction"), wholesale)
    certified = F.when(F.col("tier") == "low", blend(list(zip(sources, CERTIFIED["low"])))).when(F.col("tier") == "high", blend(list(zip(sources, CERTIFIED["high"])))).otherwise(blend(list(zip(sources, CERTIFIED["mid"]))))
    raw = blend([(sold, RAW[0]), (F.col("guide"), RAW[1]), (wholesale, RAW[2])])
    # What holds in this order: a name and the value it gives.
    ways = [
        ("bullion-spot-premium", by_spot & (sold > spot * 0.5), premium),
        ("bullion-greysheet-anchor", by_spot & sold.isNull() & anchored, wholesale * 0.7 + spot * 0.3),
        ("bullion-spot-only", by_spot & sold.isNull(), spot),
        ("certified-blend", F.col("certified"), certified),
        ("raw-blend", F.lit(True), raw),
    ]
    value = reduce(lambda rest, w: F.when(F.coalesce(w[1], F.lit(False)), w[2]).otherwise(rest), reversed(ways), F.lit(None).cast("double"))
    method = reduce(lambda rest, w: F.when(F.coalesce(w[1], F.lit(False)), F.lit(w[0])).otherwise(rest), reversed(ways), F.lit(None).cast("string"))
    appeal = clamp(F.coalesce("appeal", F.lit(1.0)), 1.0, 2.0)
    out = df.withColumn("fmv", money(money(value) * appeal)).withColumn("method", F.when(F.col("fmv").isNotNull(), method))
    alone = n == 0
    label = F.when(F.col("fmv").isNull() | (alone & F.col("method").isin("bullion-spot-only", "bullion-greysheet-anchor")), "metal-only").when(alone, "guide-only")
    label = label.when(F.col("sold_share") == 0, "asking-prices-only").when(F.col("sold_share") < 0.3, "mostly-asking").otherwise("sold-data")
    sd = F.when(n >= 2, F.col("sd")).otherwise(F.col("fmv") * 0.1)
    margin = F.greatest(sd, F.col("fmv") * 0.05)
    return out.withColumn("label", label).withColumn("range_low", money(F.greatest(F.lit(0.0), F.col("fmv") - margin))).withColumn("range_high", money(F.col("fmv") + margin))


def cohort_counts(asked: DataFrame, counts: DataFrame, least_direct: int = 3, least: int = 5, years: int = YEARS) -> DataFrame:
    """cohort, year, direct (rows of the year), around (rows of the ``years`` around it too) and ``wide`` (under ``least_direct``
    of the year, at least ``least`` around it) for each cohort and year of ``asked``.

    ``counts``: cohort, year, n; an asked year may have none. A window sees as many rows as a cohort has years."""
    both = counts.select("cohort", "year", "n", F.lit(False).alias("_asked")).union(asked.select("cohort", "year", F.lit(0).cast("bigint"), F.lit(True)).distinct())
    each = both.where("cohort IS NOT NULL AND year IS NOT NULL").groupBy("cohort", "year").agg(F.sum("n").alias("direct"), F.bool_or("_asked").alias("_asked"))
    near = F.sum("direct").over(Window.partitionBy("cohort").orderBy("year").rangeBetween(-years, years))
    out = each.withColumn("around", near).where("_asked").drop("_asked")
    return out.withColumn("wide", (F.col("direct") < least_direct) & (F.col("around") >= least))


def with_cohort(direct: DataFrame, comps: DataFrame, least_direct: int = 3, least: int = 5, years: int = YEARS) -> DataFrame:
    """Comps of a query's own year, and where there are under ``least_direct`` of them those of
    the ``years`` around it too, if that makes ``least``; ``composite`` marks them.

    ``direct``: query_id, cohort, year. ``comps``: cohort, year and others. Which years a query
    takes is told from counts by cohort and year, so only comps that are kept meet their queries."""
    counts = comps.groupBy("cohort", "year").agg(F.count(F.lit(1)).alias("n"))
    taken = direct.select("query_id", "cohort", "year").join(cohort_counts(direct, counts, least_direct, least, years), ["cohort", "year"])
    reach = F.when(F.col("wide"), F.sequence(F.col("year") - years, F.col("year") + years)).otherwise(F.array("year"))
    near = taken.select("query_id", "cohort", F.col("year").alias("_own"), F.explode(reach).alias("year"))
    return near.join(comps, ["cohort", "year"]).withColumn("composite", F.col("year") != F.col("_own")).drop("_own")


#: Points for a full sample, spread and match of bars, of coins that no guide knows and of others; comps of a full sample.
POINTS = {"bar": (35, 25, 25, 12), "uncovered": (40, 20, 25, 15), "covered": (30, 20, 15, 15)}


def confidence(
    kind: Column, n: Column, spread: Column, score: Column, *, fallback: Column | bool = False, verified: Column | bool = False, guide: Column | bool = False, auction: Column | bool = False, wholesale: Column | bool = False,
    asking_only: Column | bool = False, sold_share: Column | None = None, population: Column | None = None, margin: Column | None = None, pool_fallback: Column | bool = False, attrition: Column | None = None,
) -> Column:
    """0 to 100 for how far a value is to be trusted, whole.

    ``kind`` is ``bar``, ``uncovered`` (no guide knows the coin) or ``covered``; ``spread`` the standard deviation
    over the mean, ``score`` the mean match in per cent, ``margin`` the wholesale price's distance in per
    cent, ``attrition`` the per cent of comps that rules removed. Null flags are false, null numbers say
    nothing."""

    def points(flag: Column | bool, value: int | Column) -> Column:
        return F.when(F.coalesce(flag if isinstance(flag, Column) else F.lit(flag), F.lit(False)), value).otherwise(0)

    def base(name: str) -> Column:
        sample, close, match, full = POINTS[name]
        return F.least(n / full, F.lit(1.0)) * sample + F.greatest(F.lit(0.0), 1 - F.least(spread, F.lit(1.0))) * close + score / 100 * match

    thin = points(n < 5, -10)
    weak = points(fallback, F.when(n >= 30, 0).when(n >= 15, -7).otherwise(-15))
    bar = base("bar") + points(n >= 20, 15) + points(fallback, -5) + thin
    uncovered = base("uncovered") + points(n >= 20, 10) + points(auction, 5) + weak + thin
    covered = base("covered") + points(verified, 10) + points(guide, 10) + points(auction, 5) + points(wholesale, 5) + weak + thin
    c = F.when(kind == "bar", bar).when(kind == "uncovered", uncovered).otherwise(covered)
    asking = asking_only if isinstance(asking_only, Column) else F.lit(asking_only)
    c = c + F.when(F.coalesce(asking, F.lit(False)), -30).when(F.lit(False) if sold_share is None else sold_share < 0.3, -20).when(F.lit(False) if sold_share is None else sold_share < 0.6, -10).otherwise(0)
    if population is not None:
        c = c - F.when(kind == "bar", 0).when(population < 50, 15).when(population < 100, 10).when(population < 200, 5).otherwise(0)
    if margin is not None:
        c = c + F.when(margin <= 15, 5).when(margin >= 40, -5).otherwise(0)
    c = c + points(pool_fallback, -10)
    if attrition is not None:
        c = c - F.when(attrition > 90, 20).when(attrition > 70, 10).when(attrition > 50, 5).otherwise(0)
    return clamp(F.floor(c + 0.5).cast("double"), 0.0, 100.0)
