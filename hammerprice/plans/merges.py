"""Deduplication, merges, set operations and carried values on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.text import fingerprint
from ..operators import merge
from ..registry import query, table
from ..sources.listings import filled_down

_PRINT = "substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 80)"


@query(f"""WITH d AS (SELECT doc_id, doc_id // 3 AS item, {_PRINT} AS print FROM documents),
a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item ORDER BY doc_id) = 1)
SELECT doc_id, item FROM a QUALIFY coalesce(print, '') = '' OR row_number() OVER (PARTITION BY print ORDER BY doc_id) = 1""")
def dedup_id_then_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    plain = F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 1, 80)
    d = d.select("doc_id", F.floor(F.col("doc_id") / 3).alias("item"), plain.alias("print"))
    return merge.dedup_or(d, "item", "print", "doc_id").select("doc_id", "item")


@query("""SELECT l_partkey, l_extendedprice, CAST(l_shipdate AS DATE) AS day, min(l_orderkey) AS kept FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 0""")
def dataset_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets (odd and even orders) united; one row per title, price and day, from the lowest order."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", F.to_date("l_shipdate").alias("day"), "l_orderkey")
    both = line.where("l_orderkey % 2 = 0").unionByName(line.where("l_orderkey % 2 = 1 or l_orderkey is null"))
    return both.groupBy("l_partkey", "l_extendedprice", "day").agg(F.min("l_orderkey").alias("kept"))


@query("""WITH b AS (SELECT o_orderstatus, count(*) AS before FROM orders GROUP BY 1), a AS (SELECT o_orderstatus, count(DISTINCT o_custkey) AS after FROM orders GROUP BY 1)
SELECT o_orderstatus, before, after, after < before AS refused FROM b JOIN a USING (o_orderstatus)""")
def shrink_guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return merge.shrink_guard(orders, orders.dropDuplicates(["o_orderstatus", "o_custkey"]), ["o_orderstatus"])


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 4 <> 0)
SELECT k, coalesce(i.name, c.name) AS name, coalesce(i.bal, c.bal) AS bal, c.k IS NULL AS is_new FROM c FULL JOIN i USING (k)""")
def upsert_fieldwise_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("k % 4 <> 0").select("k", F.when(F.col("k") % 2 == 0, F.upper("name")).alias("name"), (F.col("bal") + 1).alias("bal"))
    return merge.upsert(c.where("k % 3 <> 0"), new, ["k"])


@query("""SELECT o_custkey, max(o_orderdate) AS last_at, min(o_orderdate) AS first_at, max(o_totalprice) AS most,
arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1""")
def meta_merge_fieldwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("last_at"), F.col("o_orderdate").alias("first_at"), F.col("o_totalprice").alias("most"), F.col("o_orderpriority").alias("first_priority"))
    return merge.merge_meta(o, "o_custkey", latest=["last_at"], earliest=["first_at"], most=["most"], first=["first_priority"], order="o_orderkey")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN r <= 50 THEN r END AS lot FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INT) AS r FROM orders)""")
def lot_number_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.numbered_duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "lot")


_KEYS = "k AS (SELECT p_name AS name, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') AS key, p_size AS n, p_partkey FROM part), u AS (SELECT name || ' ' || (p_partkey % 7) AS name, key, CASE WHEN n < 5 THEN 0 ELSE n END AS n, p_partkey FROM k), g AS (SELECT name, any_value(key) AS key, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY name)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))), " ")
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey") % 7).alias("name"), key.alias("key"), F.when(F.col("p_size") < 5, 0).otherwise(F.col("p_size")).alias("n"))
    return part.groupBy("name").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


@query(f"""WITH {_KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CAST(name <> key AS INT), -n, length(name), name) AS nth FROM g)
SELECT key, count(*) AS names, CAST(sum(CAST(n = 0 AS INT)) AS BIGINT) AS empty, max(n) AS most, max(n) - min(n) AS delta, max(name) FILTER (nth = 1) AS winner,
CASE WHEN sum(CAST(n = 0 AS INT)) = count(*) THEN 'all-empty' WHEN sum(CAST(n = 0 AS INT)) = 0 THEN 'all-populated' ELSE 'mixed-populated-and-empty' END AS class FROM r GROUP BY key HAVING count(*) > 1""")
def duplicate_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.duplicate_groups(_names(spark, sf_dir), "name", "key", "n")


@query(f"""WITH {_KEYS}, r AS (SELECT *, first_value(name) OVER (PARTITION BY key ORDER BY CAST(name <> key AS INT), -n, length(name), name) AS winner FROM g) SELECT name, winner, n FROM r WHERE name <> winner""")
def merge_losers_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_losers(_names(spark, sf_dir), "name", "key", "n")


@query(f"WITH {_KEYS} SELECT key, count(*) AS names, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY key")
def rekey_collision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store re-keyed to canonical keys; colliding entries are united."""
    return _names(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n"))


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN length(text) END AS own, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations""")
def carry_forward_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value missing in a row is that of the row before it."""
    own = F.when(F.col("role") == "user", F.length("text").cast("bigint"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", own.alias("own"), filled_down(own, "conv_id", "turn").alias("carried"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY r, o_orderpriority) AS BIGINT) AS place FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every order if one of each priority comes in turn, oldest first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("at"))
    return merge.interleaved(orders, "kind", "at", "o_orderkey").select("o_orderkey", "place")


@query("SELECT o_orderpriority, date_trunc('day', o_orderdate)::DATE AS day, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, date_trunc('day', o_orderdate) ORDER BY o_orderkey) = 1")
def first_write_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of indebted customers without a returned line."""
    o, poor = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal < 0")
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return o.join(poor, o.o_custkey == poor.c_custkey, "left_semi").join(back, o.o_orderkey == back.l_orderkey, "left_anti").select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, substr(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g'), 1, 80) || '|' || CAST(CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS VARCHAR) || '|' || strftime(l_shipdate, '%Y-%m-%d') AS print FROM lineitem JOIN part ON l_partkey = p_partkey""")
def listing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", fingerprint(F.concat_ws(" ", "p_name", "p_brand"), F.col("l_extendedprice"), F.col("l_shipdate")).alias("print"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS runs, floor(sum(value) * 100 + 0.5) / 100 AS total, count(DISTINCT event_type) AS kinds, max(ts) AS last_at FROM events GROUP BY user_id""")
def run_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per run of the telemetry: counts, sums, last time."""
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)"))
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("runs"), money(F.sum("value").cast("double")).alias("total"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("last_at"))
