"""Robust statistics of prices and fair values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import blend, clamp, ladder, money, whole
from ..operators import robust
from ..registry import query, table
from .common import AS_OF, SALES, as_of, m, sales

_MED = "med AS (SELECT brand, median(price) AS med, count(price) AS n FROM sales GROUP BY brand), mad AS (SELECT s.brand, any_value(med) AS med, any_value(n) AS n, median(abs(price - med)) AS mad FROM sales s JOIN med USING (brand) GROUP BY s.brand)"
_FLAG = f"{_MED}, flagged AS (SELECT s.*, n < 4 OR (price >= med - mad * 1.4826 * 3.5 AND price <= med + mad * 1.4826 * 3.5) AS kept, med, mad FROM sales s JOIN mad USING (brand))"
_WEIGHT = f"CAST(1.0::DOUBLE / (1 + greatest(1.0::DOUBLE, (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(sold)) / 86400000.0::DOUBLE) / 90.0::DOUBLE) AS DECIMAL(18,9))"


def fair_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.fair_values(sales(spark, sf_dir), ["brand"], "price", robust.recency_weight(F.col("sold"), as_of(), 90))


_VALUE = f"""{SALES}, {_FLAG}, kept AS (SELECT *, {_WEIGHT} AS w FROM flagged WHERE kept),
each_ AS (SELECT brand, price, sum(w) AS w FROM kept GROUP BY brand, price),
run AS (SELECT brand, price, sum(w) OVER (PARTITION BY brand ORDER BY price ROWS UNBOUNDED PRECEDING) AS running, sum(w) OVER (PARTITION BY brand) AS total FROM each_),
value AS (SELECT brand, min(price) FILTER (running * 2 >= total) AS fair_value FROM run GROUP BY brand)"""


@query(f"""WITH {_VALUE} SELECT brand, any_value(fair_value) AS fair_value, count(*) FILTER (kept) AS n, min(price) FILTER (kept) AS low,
max(price) FILTER (kept) AS high, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS removed FROM flagged JOIN value USING (brand) GROUP BY brand""")
def flagship_fair_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency-weighted median per brand after outliers are gone, with range and removals."""
    return fair_values(spark, sf_dir)


@query(f"""WITH {SALES}, {_MED} SELECT brand, count(price) AS count, {m("avg(price)")} AS mean, {m("median(price)")} AS median, {m("quantile_cont(price, 0.25)")} AS p25,
{m("quantile_cont(price, 0.75)")} AS p75, {m("min(price)")} AS min, {m("max(price)")} AS max, {m("coalesce(stddev_samp(price), 0)")} AS stddev, {m("any_value(mad)")} AS mad
FROM sales JOIN mad USING (brand) GROUP BY brand""")
def price_summary_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.summary(sales(spark, sf_dir), ["brand"], "price")


@query(f"WITH {SALES} SELECT brand, " + ", ".join(f"floor(quantile_cont(price, {p / 100}) * 10000 + 0.5) / 10000 AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM sales GROUP BY brand")
def percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = [(F.floor(F.percentile("price", F.lit(p / 100)) * 10000 + 0.5) / 10000).alias(f"p{p}") for p in (5, 25, 50, 75, 95)]
    return sales(spark, sf_dir).groupBy("brand").agg(*bands)


@query(f"WITH {SALES}, {_FLAG} SELECT brand, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed, {m('any_value(med)')} AS med, {m('any_value(mad)')} AS mad FROM flagged GROUP BY brand")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = robust.with_spread(robust.value_counts(sales(spark, sf_dir), ["brand"], "price"), ["brand"], "price").withColumn("kept", robust.inside_fence("price"))
    rows = F.sum(F.when(F.col("kept"), F.col("c")).otherwise(0))
    return each.groupBy("brand").agg(rows.alias("kept"), (F.sum("c") - rows).alias("removed"), money(F.max("med")).alias("med"), money(F.max("mad")).alias("mad"))


@query(f"""WITH {SALES}, l AS (SELECT kind, list(price ORDER BY price) AS p FROM sales GROUP BY kind),
q AS (SELECT kind, p[CAST(floor(len(p) * 0.25) AS BIGINT) + 1] AS q1, p[CAST(floor(len(p) * 0.75) AS BIGINT) + 1] AS q3, len(p) AS n FROM l)
SELECT kind, any_value(q1) AS q1, any_value(q3) AS q3, count(*) FILTER (n < 4 OR (price >= q1 - (q3 - q1) * 1.5 AND price <= q3 + (q3 - q1) * 1.5)) AS kept, count(*) AS n FROM sales JOIN q USING (kind) GROUP BY kind""")
def iqr_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = robust.iqr_flag(sales(spark, sf_dir), ["kind"], "price")
    return rows.groupBy("kind").agg(F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))


@query("""WITH each_ AS (SELECT l_partkey AS part_key, l_extendedprice AS price, sum(CASE WHEN l_quantity = 0 THEN 1 ELSE CAST(l_quantity AS DECIMAL(18,9)) END) AS w FROM lineitem GROUP BY 1, 2),
run AS (SELECT part_key, price, sum(w) OVER (PARTITION BY part_key ORDER BY price ROWS UNBOUNDED PRECEDING) AS running, sum(w) OVER (PARTITION BY part_key) AS total FROM each_)
SELECT part_key, min(price) FILTER (running * 2 >= total) AS weighted_median FROM run GROUP BY part_key""")
def weighted_median_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("decimal(18,9)").alias("w"))
    return robust.weighted_median(rows, ["part_key"], "price", "w")


_SOURCES = "SELECT p_partkey AS part_key, p_retailprice AS guide, sold, CASE WHEN p_size > 25 THEN p_retailprice * 0.9 END AS wholesale FROM part LEFT JOIN (SELECT l_partkey, median(l_extendedprice / l_quantity) AS sold FROM lineitem WHERE l_quantity > 0 GROUP BY 1) ON l_partkey = p_partkey"


@query(f"""WITH s AS ({_SOURCES}) SELECT part_key, {m("(coalesce(sold * 0.5, 0) + coalesce(guide * 0.3, 0) + coalesce(wholesale * 0.2, 0)) / ((CASE WHEN sold IS NULL THEN 0.0 ELSE 0.5 END) + (CASE WHEN guide IS NULL THEN 0.0 ELSE 0.3 END) + (CASE WHEN wholesale IS NULL THEN 0.0 ELSE 0.2 END))")} AS value FROM s""")
def source_blend_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_retailprice").alias("guide"), F.when(F.col("p_size") > 25, F.col("p_retailprice") * 0.9).alias("wholesale"))
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("part_key")).agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("sold"))
    return part.join(sold, "part_key", "left").select("part_key", money(blend([(F.col("sold"), 0.5), (F.col("guide"), 0.3), (F.col("wholesale"), 0.2)])).alias("value"))


#: Value bound, share of the value to pay (low, middle, high).
BUY = [(50, (0.60, 0.70, 0.75)), (200, (0.70, 0.75, 0.80)), (1_000, (0.75, 0.80, 0.85)), (5_000, (0.80, 0.85, 0.90)), (None, (0.85, 0.90, 0.95))]
#: Shift of buying and selling shares by where one trades.
CONTEXT = {"retail": (0.0, 0.0), "private": (0.07, -0.10), "wholesale": (-0.10, -0.20)}


def buy_bands(value, context: str = "retail"):
    """max_low, max_mid, max_high: prices to pay."""
    shift = CONTEXT[context][0]
    out = []
    for i, name in enumerate(("max_low", "max_mid", "max_high")):
        share = ladder(value, [(bound, min(shares[i] + shift, 0.99)) for bound, shares in BUY[:-1]], min(BUY[-1][1][i] + shift, 0.99))
        out.append(money(value * share).alias(name))
    return out


def sell_bands(median, p25, scarce, context: str = "retail"):
    """fast, normal, premium and offer_floor: prices to ask."""
    shift = CONTEXT[context][1]
    top = F.when(scarce, 1.15).otherwise(1.05) + shift
    floor = F.least(p25 * (1 + shift), median * (0.92 + shift))
    return [money(x).alias(n) for n, x in (("fast", median * (0.92 + shift)), ("normal", median * (1.0 + shift)), ("premium", median * top), ("offer_floor", floor))]


def _share(i: int) -> str:
    return "CASE " + " ".join(f"WHEN value <= {b} THEN {s[i]}::DOUBLE" for b, s in BUY[:-1]) + f" ELSE {BUY[-1][1][i]}::DOUBLE END"


_STATS = f"{SALES}, s AS (SELECT brand, median(price) AS value, quantile_cont(price, 0.25) AS p25, coalesce(stddev_samp(price), 0) AS sd, count(*) AS n FROM sales GROUP BY brand)"


@query(f"""WITH {_STATS} SELECT brand, {", ".join(f"{m(f'value * ({_share(i)})')} AS {n}" for i, n in enumerate(("max_low", "max_mid", "max_high")))},
{m("value * 0.92::DOUBLE")} AS fast, {m("value * 1.0::DOUBLE")} AS normal, {m("value * (CASE WHEN n < 200 THEN 1.15::DOUBLE ELSE 1.05::DOUBLE END)")} AS premium, {m("least(p25, value * 0.92::DOUBLE)")} AS offer_floor,
{m("greatest(0, value - greatest(sd, value * 0.05::DOUBLE))")} AS range_low, {m("value + greatest(sd, value * 0.05::DOUBLE)")} AS range_high,
CASE WHEN p25 <= {m(f"value * ({_share(2)})")} THEN 'BUY' ELSE 'PASS' END AS recommendation FROM s""")
def buy_sell_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices to pay and to ask, the range, and whether the lower quartile is a price to buy at."""
    s = sales(spark, sf_dir).groupBy("brand").agg(F.median("price").alias("value"), F.percentile("price", F.lit(0.25)).alias("p25"), F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))
    value, margin = F.col("value"), F.greatest("sd", F.col("value") * 0.05)
    out = s.select("brand", "p25", *buy_bands(value), *sell_bands(value, F.col("p25"), F.col("n") < 200), money(F.greatest(F.lit(0.0), value - margin)).alias("range_low"), money(value + margin).alias("range_high"))
    return out.withColumn("recommendation", F.when(F.col("p25") <= F.col("max_high"), "BUY").otherwise("PASS")).drop("p25")


def confidence(n, dispersion, score, guide, auction, wholesale, verified, asking_only, population, attrition):
    """0 to 100 from sample size, spread, match quality and sources, less what speaks against them."""
    c = F.least(n / 15, F.lit(1.0)) * 30 + F.greatest(F.lit(0.0), 1 - F.least(dispersion, F.lit(1.0))) * 20 + score / 100 * 15
    for flag, points in ((verified, 10), (guide, 10), (auction, 5), (wholesale, 5), (asking_only, -30), (n < 5, -10)):
        c = c + F.when(flag, points).otherwise(0)
    c = c - F.when(population < 50, 15).when(population < 100, 10).when(population < 200, 5).otherwise(0)
    c = c - F.when(attrition > 90, 20).when(attrition > 70, 10).when(attrition > 50, 5).otherwise(0)
    return clamp(whole(c).cast("double"), 0.0, 100.0)


@query(f"""WITH {SALES}, s AS (SELECT part_key, count(*) AS n, {m("coalesce(stddev_samp(price), 0) / avg(price)")} AS d, sum(quantity) AS population FROM sales GROUP BY part_key)
SELECT part_key, greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor(least(n / 15, 1.0::DOUBLE) * 30 + greatest(0.0::DOUBLE, 1 - least(d, 1.0::DOUBLE)) * 20 + 70.0::DOUBLE / 100 * 15
 + CASE WHEN part_key % 2 = 0 THEN 10 ELSE 0 END + 10 + CASE WHEN part_key % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN part_key % 5 = 0 THEN -30 ELSE 0 END + CASE WHEN n < 5 THEN -10 ELSE 0 END
 - CASE WHEN population < 50 THEN 15 WHEN population < 100 THEN 10 WHEN population < 200 THEN 5 ELSE 0 END - CASE WHEN part_key % 100 > 90 THEN 20 WHEN part_key % 100 > 70 THEN 10 WHEN part_key % 100 > 50 THEN 5 ELSE 0 END + 0.5))) AS confidence FROM s""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).groupBy("part_key").agg(F.count(F.lit(1)).alias("n"), money(F.coalesce(F.stddev_samp("price"), F.lit(0.0)) / F.avg("price")).alias("d"), F.sum("quantity").alias("population"))
    k = F.col("part_key")
    c = confidence(F.col("n"), F.col("d"), F.lit(70.0), F.lit(True), k % 3 == 0, F.lit(False), k % 2 == 0, k % 5 == 0, F.col("population"), k % 100)
    return s.select("part_key", c.alias("confidence"))


@query(f"""WITH {SALES}, {_MED}, tiers AS (SELECT part_key, count(*) FILTER (sold >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND sold <= TIMESTAMP '{AS_OF}') AS d90,
 count(*) FILTER (sold >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND sold <= TIMESTAMP '{AS_OF}') AS d365, count(*) AS n FROM sales GROUP BY part_key)
SELECT part_key, CASE WHEN d90 >= 3 THEN '90d' WHEN d365 >= 3 THEN '365d' ELSE 'all' END AS tier, CASE WHEN d90 >= 3 THEN d90 WHEN d365 >= 3 THEN d365 ELSE n END AS n FROM tiers""")
def tier_ladder_first_satisfying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest look-back with three sales at least."""
    rows = sales(spark, sf_dir)

    def since(days: int):
        return F.count_if((F.col("sold") >= as_of() - F.make_dt_interval(F.lit(days))) & (F.col("sold") <= as_of()))

    t = rows.groupBy("part_key").agg(since(90).alias("d90"), since(365).alias("d365"), F.count(F.lit(1)).alias("n"))
    tier = F.when(F.col("d90") >= 3, "90d").when(F.col("d365") >= 3, "365d").otherwise("all")
    n = F.when(F.col("d90") >= 3, F.col("d90")).when(F.col("d365") >= 3, F.col("d365")).otherwise(F.col("n"))
    return t.select("part_key", tier.alias("tier"), n.alias("n"))
