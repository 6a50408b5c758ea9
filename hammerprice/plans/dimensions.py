"""Dimension queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims
from ..registry import query, table
from .common import m

_ANIMALS = "[" + ", ".join(f"'{a}'" for a in dims.ANIMALS) + "]"


@query(f"SELECT p_partkey, CASE WHEN y >= 1996 THEN {_ANIMALS}[((y - 2020) % 12 + 12) % 12 + 1] END AS animal, CASE WHEN y BETWEEN 1996 AND 2007 THEN 'I' WHEN y BETWEEN 2008 AND 2019 THEN 'II' WHEN y BETWEEN 2020 AND 2031 THEN 'III' END AS series FROM (SELECT p_partkey, 1980 + p_size AS y FROM part)")
def lunar_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("p_size") + 1980
    return table(spark, sf_dir, "part").select("p_partkey", dims.animal(y).alias("animal"), dims.lunar_series(y).alias("series"))


_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'Silver Eagle' WHEN 1 THEN 'Maple Leaf' WHEN 2 THEN 'panda' WHEN 3 THEN 'Barber Half' WHEN 4 THEN 'mercury' WHEN 5 THEN 'wheat penny' WHEN 6 THEN 'Lunar Kangaroo' ELSE p_name END"


@query(f"SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(lower({_NAMES}), '{p}') THEN {n}" for p, n in dims.ROLLS)} END AS pieces FROM part")
def roll_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", dims.roll_quantity(F.expr(_NAMES)).alias("pieces"))


#: A made-up item from a part.
_SERIES = "CASE p_partkey % 9 WHEN 0 THEN 'American Gold Eagle' WHEN 1 THEN 'American Silver Eagle' WHEN 2 THEN 'Chinese Silver Panda' WHEN 3 THEN 'Lunar Series II' WHEN 4 THEN 'Mexican Gold Libertad' END"
_ITEM = f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' WHEN 2 THEN 'platinum' WHEN 3 THEN 'palladium' END AS metal, {_SERIES} AS series,
CASE p_partkey % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'round' WHEN 2 THEN 'coin' END AS form, CASE p_size % 7 WHEN 0 THEN 0.03 WHEN 1 THEN 0.25 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 10 WHEN 5 THEN 100 END AS weight,
CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) % 7000 AS points FROM part"""
_ROWS = ", ".join(f"({i}, '{key}', {low:.2f}, {high:.2f})" for i, (key, low, high, _) in enumerate(dims.PREMIUMS))
_HELD = " UNION ALL ".join(f"SELECT p_partkey, {i} AS nth FROM p WHERE {condition}" for i, (*_, condition) in enumerate(dims.PREMIUMS))


@query(f"""WITH q AS ({_ITEM}), p AS (SELECT p_partkey, metal, coalesce(series, '') AS series, coalesce(form, '') AS form, coalesce(weight, 0) AS weight FROM q WHERE metal IS NOT NULL),
h AS (SELECT p_partkey, min(nth) AS nth FROM ({_HELD}) GROUP BY 1), r(nth, key, low, high) AS (VALUES {_ROWS})
SELECT q.p_partkey, r.key, CASE WHEN r.key IS NULL THEN 'unknown' WHEN points < CAST(low * 10000 AS BIGINT) THEN 'low' WHEN points > CAST(high * 10000 AS BIGINT) THEN 'high' ELSE 'normal' END AS verdict FROM q LEFT JOIN h ON h.p_partkey = q.p_partkey LEFT JOIN r ON r.nth = h.nth""")
def premium_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a premium over melt value is usual."""
    q = dims.with_premium(spark.sql(_ITEM.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")))
    return q.select("p_partkey", F.col("band.key").alias("key"), dims.premium_verdict(F.col("points") / 10000 + 1, F.lit(1.0), F.col("band")).alias("verdict"))


@query("""WITH t AS (SELECT min(p_partkey) AS type_id, p_name || ' ' || p_type AS title, min(p_size) AS first, max(p_size) - 10 AS last, min(p_brand) AS metal FROM part GROUP BY p_name, p_type),
q AS (SELECT p_partkey AS item_id, list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda w: length(w) > 2) AS words, p_size AS year, p_brand AS metal FROM part),
s AS (SELECT item_id, type_id, CASE WHEN year BETWEEN first AND last THEN 20 ELSE 0 END + 5 * len(list_intersect(words, string_split(lower(title), ' '))) + CASE WHEN q.metal = t.metal THEN 10 ELSE 0 END AS score FROM q, t WHERE len(list_intersect(words, string_split(lower(title), ' '))) > 0)
SELECT item_id, type_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, type_id) = 1""")
def catalogue_type_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue type (a name and kind, known by its lowest part) that fits each part best."""
    part = table(spark, sf_dir, "part")
    t = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("type_id"), F.min("p_size").alias("first"), (F.max("p_size") - 10).alias("last"), F.min("p_brand").alias("metal"))
    t = t.select("type_id", F.concat_ws(" ", "p_name", "p_type").alias("title"), "first", "last", "metal")
    q = part.select(F.col("p_partkey").alias("item_id"), F.split(F.lower("p_name"), " ").alias("words"), F.col("p_size").alias("year"), F.col("p_brand").alias("metal"))
    return dims.best_type(q, t)


@query("""WITH i AS (SELECT l_partkey AS k, year(l_shipdate) AS y, max(CASE WHEN l_quantity > 5 THEN CAST(l_quantity * l_quantity AS BIGINT) END) AS mintage FROM lineitem GROUP BY 1, 2)
SELECT k, y, mintage, CASE WHEN mintage <= 5 THEN 'Unique' WHEN mintage <= 25 THEN 'Extremely Rare' WHEN mintage <= 100 THEN 'Very Rare' WHEN mintage <= 1000 THEN 'Rare' WHEN mintage <= 10000 THEN 'Scarce' END AS rarity FROM i""")
def cell_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").cast("bigint").alias("y"), F.when(F.col("l_quantity") > 5, (F.col("l_quantity") * F.col("l_quantity")).cast("bigint")).alias("mintage"))
    return dims.cell_rarity(line.select("k", "y").distinct(), line, ["k", "y"])


@query(f"""SELECT o_custkey, count(o_totalprice) AS count, {m("median(o_totalprice)")} AS median, max(o_totalprice) AS high, min(o_totalprice) AS low, {m("CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)")} AS mean,
list_sort(list_distinct(list(o_orderpriority))) AS houses, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def auction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("house"), F.to_date("o_orderdate").alias("day"))
    return dims.auction_stats(o, ["o_custkey"])
