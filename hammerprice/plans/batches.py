"""A batch of items priced in one plan, and what a value is to be trusted, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, value
from ..registry import query, table
from .common import AS_OF, SALES, as_of, m, sales

_POOL = "CASE WHEN l_tax >= 0.06 THEN 'graded' WHEN l_tax >= 0.05 THEN 'proof' ELSE 'raw' END"
_WANTED = "CASE p_partkey % 3 WHEN 0 THEN 'graded' WHEN 1 THEN 'raw' ELSE 'proof' END"


@query(f"""WITH c AS (SELECT l_partkey AS ds, {_POOL} AS pool, l_orderkey * 8 + l_linenumber AS id, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, CAST(l_discount * 100 AS INT) * 10 AS score, CASE WHEN l_linenumber < 7 THEN l_shipdate END AS sa,
  year(l_shipdate) AS y, p_brand AS cohort, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END AS src, l_discount < 0.09 AS kept FROM lineitem JOIN part ON p_partkey = l_partkey),
q AS (SELECT p_partkey AS k, {_WANTED} AS pool, CASE WHEN p_partkey % 2 = 0 THEN 120 ELSE 180 END AS asked, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 3 ELSE 8 END AS least, p_brand AS cohort, CASE WHEN p_size % 5 = 0 THEN 1992 + p_size % 7 END AS y, p_retailprice AS retail, p_type FROM part),
a AS (SELECT q.k, q.asked, q.least, c.id, c.price, c.score, c.kept, coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(sa), -1e18) / 86400 AS age FROM q JOIN c ON c.ds = q.k AND c.pool = q.pool AND src = 1),
w AS (SELECT k, CASE WHEN count(*) FILTER (age <= asked) >= any_value(least) THEN any_value(asked) WHEN count(*) FILTER (age <= greatest(asked, 180)) >= any_value(least) THEN 180 WHEN count(*) FILTER (age <= 365) >= any_value(least) THEN 365 WHEN count(*) FILTER (age <= 730) >= any_value(least) THEN 730 END AS days FROM a GROUP BY k),
one AS (SELECT a.* FROM a JOIN w USING (k) WHERE kept AND (days IS NULL OR age <= days)),
n1 AS (SELECT q.*, w.days, w.k IS NOT NULL AS any1, (SELECT count(*) FROM one WHERE one.k = q.k) AS n FROM q LEFT JOIN w USING (k)),
r AS (SELECT n1.k, c.id, c.price, c.score, c.y <> n1.y AS other, c.pool = n1.pool AS mine, c.y AS cy FROM n1 JOIN c ON c.cohort = n1.cohort AND src = 1 AND kept AND abs(c.y - n1.y) <= 3 WHERE n1.n < n1.least),
rn AS (SELECT k, count(*) FILTER (NOT other) AS d, count(*) AS n FROM r GROUP BY k HAVING d < 3 AND n >= 5),
near AS (SELECT r.* FROM r JOIN rn USING (k) WHERE mine), wide AS (SELECT k FROM near GROUP BY k HAVING bool_or(other)),
h AS (SELECT * FROM n1 WHERE n < least AND k NOT IN (SELECT k FROM wide)),
b AS (SELECT h.k, h.asked, h.least, h.n AS held, c.id, c.price, c.score, coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(c.sa), -1e18) / 86400 AS age FROM h JOIN c ON c.ds = h.k AND c.pool = h.pool AND src = 2 AND c.kept),
v AS (SELECT k, CASE WHEN any_value(held) + count(*) FILTER (age <= asked) >= any_value(least) THEN any_value(asked) WHEN any_value(held) + count(*) FILTER (age <= greatest(asked, 180)) >= any_value(least) THEN 180 ELSE 365 END AS days FROM b WHERE age <= 365 GROUP BY k),
two AS (SELECT b.* FROM b JOIN v USING (k) WHERE age <= days),
comps AS (SELECT k, id, price, score, 1 AS sold, 'stored' AS route FROM one JOIN n1 USING (k) WHERE n1.n >= n1.least UNION ALL SELECT k, id, price, score, 1, 'neighbours' FROM near JOIN wide USING (k) UNION ALL SELECT k, id, price, score, 1, 'h' FROM one WHERE k IN (SELECT k FROM h) UNION ALL SELECT k, id, price, score, 1, 'h' FROM two),
zero AS (SELECT k FROM h WHERE k NOT IN (SELECT k FROM comps)),
every AS (SELECT * FROM comps UNION ALL SELECT z.k, c.id, c.price, c.score, 0, 'active' FROM zero z JOIN q ON q.k = z.k JOIN c ON c.ds = q.k AND c.pool = q.pool AND src = 3 AND c.kept),
s AS (SELECT k, count(*) AS n, median(price) AS med, avg(sold) AS sold, avg(score) AS score, coalesce(stddev_samp(price), 0) / avg(price) AS spread, any_value(route) AS route FROM every GROUP BY k),
f AS (SELECT n1.k, n1.asked, s.n, s.med, s.score, s.spread, s.sold, CASE WHEN s.route = 'h' THEN CASE WHEN v.k IS NOT NULL THEN 'searched' ELSE 'stored' END ELSE s.route END AS route, n1.days, v.days AS vd, v.k AS vk, CASE WHEN p_type <> 'PROMO' THEN floor(retail * 60 + 0.5) / 100 END AS guide, p_type FROM n1 LEFT JOIN s USING (k) LEFT JOIN v USING (k)),
t AS (SELECT *, CASE route WHEN 'neighbours' THEN 'all' WHEN 'searched' THEN vd::VARCHAR WHEN 'stored' THEN coalesce(days::VARCHAR, 'all') END AS tier, CASE route WHEN 'searched' THEN vd WHEN 'stored' THEN days END AS used,
  {m("CASE WHEN med IS NOT NULL AND guide IS NOT NULL THEN (med * 0.7::DOUBLE + guide * 0.1::DOUBLE) / (0.7::DOUBLE + 0.1::DOUBLE) WHEN med IS NOT NULL THEN med * 0.7::DOUBLE / 0.7::DOUBLE ELSE guide * 0.1::DOUBLE / 0.1::DOUBLE END")} AS fmv, coalesce(n, 0) AS c,
  CASE WHEN p_type = 'SMALL' THEN 'bar' WHEN p_type = 'PROMO' THEN 'uncovered' ELSE 'covered' END AS kind FROM f)
SELECT k AS query_id, CASE WHEN k % 97 = 5 THEN 'missing query' WHEN fmv IS NULL THEN 'no data' ELSE 'ok' END AS status, CASE WHEN k % 97 <> 5 THEN route END AS route, CASE WHEN k % 97 <> 5 THEN tier END AS reach, CASE WHEN k % 97 <> 5 THEN coalesce(tier = 'all' OR used > asked, false) END AS extended,
CASE WHEN k % 97 <> 5 THEN c END AS comps, CASE WHEN k % 97 <> 5 THEN med END AS median, CASE WHEN k % 97 <> 5 THEN fmv END AS fmv,
CASE WHEN k % 97 <> 5 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor(CASE kind WHEN 'bar' THEN least(c / 12, 1.0::DOUBLE) * 35 + greatest(0.0::DOUBLE, 1 - least(coalesce(spread, 1.0::DOUBLE), 1.0::DOUBLE)) * 25 + coalesce(score, 0.0::DOUBLE) / 100 * 25 + CASE WHEN c >= 20 THEN 15 ELSE 0 END - CASE WHEN coalesce(route = 'active', false) THEN 5 ELSE 0 END
  WHEN 'uncovered' THEN least(c / 15, 1.0::DOUBLE) * 40 + greatest(0.0::DOUBLE, 1 - least(coalesce(spread, 1.0::DOUBLE), 1.0::DOUBLE)) * 20 + coalesce(score, 0.0::DOUBLE) / 100 * 25 + CASE WHEN c >= 20 THEN 10 ELSE 0 END - CASE WHEN coalesce(route = 'active', false) THEN CASE WHEN c >= 30 THEN 0 WHEN c >= 15 THEN 7 ELSE 15 END ELSE 0 END
  ELSE least(c / 15, 1.0::DOUBLE) * 30 + greatest(0.0::DOUBLE, 1 - least(coalesce(spread, 1.0::DOUBLE), 1.0::DOUBLE)) * 20 + coalesce(score, 0.0::DOUBLE) / 100 * 15 + CASE WHEN guide IS NOT NULL THEN 10 ELSE 0 END - CASE WHEN coalesce(route = 'active', false) THEN CASE WHEN c >= 30 THEN 0 WHEN c >= 15 THEN 7 ELSE 15 END ELSE 0 END END
  - CASE WHEN c < 5 THEN 10 ELSE 0 END - CASE WHEN coalesce(sold = 0, false) THEN 30 ELSE 0 END + 0.5))) END AS confidence FROM t""")
def price_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts priced as one batch: stored sales, neighbouring years, a second source, asking prices."""
    part = table(spark, sf_dir, "part")
    shipped = F.col("l_shipdate").cast("timestamp")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("dataset"), F.expr(_POOL).alias("pool"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), price.alias("price"), (F.expr("CAST(l_discount * 100 AS INT)") * 10).alias("score"),
        F.when(F.col("l_linenumber") < 7, shipped).alias("sold_at"), F.year(shipped).alias("year"), (F.col("l_discount") < 0.09).alias("kept"), "l_returnflag",
    )
    # A part's own comps are of the pool that follows from its key; neighbours are of any, and their cohort is their part's.
    comps = line.where(F.col("pool") == F.expr(_WANTED.replace("p_partkey", "dataset")))
    around = line.where("l_returnflag = 'R'").join(part.select(F.col("p_partkey").alias("dataset"), F.col("p_brand").alias("cohort")), "dataset")
    k = F.col("p_partkey")
    kind = F.when(F.col("p_type") == "SMALL", "bar").when(F.col("p_type") == "PROMO", "uncovered").otherwise("covered")
    least = F.when(F.col("p_size") % 4 == 0, 1).when(F.col("p_size") % 4 == 1, 3).otherwise(8)
    queries = part.select(k.alias("query_id"), k.alias("dataset"), F.expr(_WANTED).alias("pool"), F.when(k % 2 == 0, 120).otherwise(180).alias("asked"), least.alias("least"), F.col("p_brand").alias("cohort"), F.when(F.col("p_size") % 5 == 0, 1992 + F.col("p_size") % 7).alias("year"))
    found, ways = cascade.summed(queries, comps.where("l_returnflag = 'R'"), comps.where("l_returnflag = 'A'"), comps.where("coalesce(l_returnflag NOT IN ('R', 'A'), true)"), as_of(), around)
    none = F.lit(None).cast("double")
    guide = F.when(F.col("p_type") != "PROMO", F.floor(F.col("p_retailprice") * 60 + 0.5) / 100)
    items = part.select(
        k.alias("query_id"), F.when(k % 97 != 5, F.col("p_name")).alias("query"), none.alias("spot"), none.alias("wholesale"), guide.alias("guide"), none.alias("auction"), F.lit(False).alias("bullion"), F.lit(False).alias("proof"),
        F.lit(False).alias("certified"), F.lit("mid").alias("tier"), F.lit(1.0).alias("appeal"), kind.alias("kind"),
    )
    return cascade.priced(items, found, ways).drop("method")


@query(f"""WITH {SALES}, s AS (SELECT part_key AS k, count(*) AS n, {m("coalesce(stddev_samp(price), 0) / avg(price)")} AS d, sum(quantity) AS pop FROM sales GROUP BY part_key),
p AS (SELECT *, least(n / CASE k % 3 WHEN 0 THEN 12 ELSE 15 END, 1.0::DOUBLE) * CASE k % 3 WHEN 0 THEN 35 WHEN 1 THEN 40 ELSE 30 END + greatest(0.0::DOUBLE, 1 - least(d, 1.0::DOUBLE)) * CASE k % 3 WHEN 0 THEN 25 ELSE 20 END + (k % 101)::DOUBLE / 100 * CASE k % 3 WHEN 2 THEN 15 ELSE 25 END AS base,
 CASE WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN -5 WHEN n >= 30 THEN 0 WHEN n >= 15 THEN -7 ELSE -15 END ELSE 0 END AS fall FROM s)
SELECT k AS part_key, greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor(base + fall + CASE WHEN n >= 20 THEN CASE k % 3 WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 0 END ELSE 0 END - CASE WHEN n < 5 THEN 10 ELSE 0 END
 + CASE WHEN k % 3 = 2 THEN CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 11 < 5 THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN k % 3 > 0 AND k % 13 < 6 THEN 5 ELSE 0 END
 + CASE WHEN k % 17 = 0 THEN -30 WHEN k % 10 < 3 THEN -20 WHEN k % 10 < 6 THEN -10 ELSE 0 END - CASE WHEN k % 3 = 0 THEN 0 WHEN pop < 50 THEN 15 WHEN pop < 100 THEN 10 WHEN pop < 200 THEN 5 ELSE 0 END
 + CASE WHEN k % 19 * 4 <= 15 THEN 5 WHEN k % 19 * 4 >= 40 THEN -5 ELSE 0 END - CASE WHEN k % 23 = 0 THEN 10 ELSE 0 END - CASE WHEN k % 100 > 90 THEN 20 WHEN k % 100 > 70 THEN 10 WHEN k % 100 > 50 THEN 5 ELSE 0 END + 0.5))) AS confidence FROM p""")
def confidence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each part's sales are to be trusted: bars, coins that no guide knows, and others."""
    s = sales(spark, sf_dir).groupBy("part_key").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.coalesce(F.stddev_samp("price"), F.lit(0.0)) / F.avg("price") * 100 + 0.5) / 100).alias("d"), F.sum("quantity").alias("population"))
    k = F.col("part_key")
    kind = F.when(k % 3 == 0, "bar").when(k % 3 == 1, "uncovered").otherwise("covered")
    c = value.confidence(
        kind, F.col("n"), F.col("d"), (k % 101).cast("double"), fallback=k % 4 == 0, verified=k % 5 == 0, guide=k % 7 == 0, auction=k % 13 < 6, wholesale=k % 11 < 5, asking_only=k % 17 == 0, sold_share=(k % 10) / 10,
        population=F.col("population"), margin=k % 19 * 4, pool_fallback=k % 23 == 0, attrition=k % 100,
    )
    return s.select("part_key", c.alias("confidence"))
