"""Portfolio, lot, freshness and monitoring queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import ladder, money
from ..operators import freshness
from ..registry import query, table
from .common import AS_OF, as_of, m


def _cents(name: str):
    """Sums of decimals don't depend on the order."""
    return F.col(name).cast("decimal(18,2)")


def lot_summary(df: DataFrame, keys: list[str], value: str, score: str, bullion: str) -> DataFrame:
    """Priced lots by group: totals, discounts (size, confidence, concentration) and three prices to bid."""
    v = F.when(F.col(value) > 0, _cents(value))
    g = df.where(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("total"), F.avg(F.coalesce(score, F.lit(0))).alias("score"), F.sum(F.when(F.col(bullion), v)).cast("double").alias("bullion"), F.max(v).cast("double").alias("most"))
    size = ladder(F.col("n"), [(10, 0.0), (50, 0.05), (100, 0.10), (250, 0.15)], 0.20)
    off = size + F.when(F.col("score") < 60, 0.05).otherwise(0.0) + F.when(F.col("most") / F.col("total") > 0.5, 0.03).otherwise(0.0)
    g = g.withColumn("discount", off)
    bids = [money(F.col("total") * F.greatest(F.lit(low), F.lit(top) - F.col("discount"))).alias(name) for name, low, top in (("cherry_pick", 0.4, 0.6), ("fair_lot", 0.5, 0.75), ("full_retail", 0.6, 0.87))]
    share = F.floor(F.coalesce(F.col("bullion"), F.lit(0.0)) / F.col("total") * 1000 + 0.5) / 10
    return g.select(*keys, "n", money(F.col("total")).alias("total"), share.alias("bullion_pct"), money(F.col("discount")).alias("discount"), *bids)


_LOT = """g AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, avg(o_orderkey % 100) AS score, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS bullion, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS most FROM orders WHERE o_totalprice > 0 GROUP BY 1),
d AS (SELECT *, CASE WHEN n <= 10 THEN 0.0::DOUBLE WHEN n <= 50 THEN 0.05::DOUBLE WHEN n <= 100 THEN 0.1::DOUBLE WHEN n <= 250 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN score < 60 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN most / total > 0.5 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS discount FROM g)"""


@query(f"""WITH {_LOT} SELECT o_custkey, n, {m("total")} AS total, floor(coalesce(bullion, 0) / total * 1000 + 0.5) / 10 AS bullion_pct, {m("discount")} AS discount,
{m("total * greatest(0.4::DOUBLE, 0.6::DOUBLE - discount)")} AS cherry_pick, {m("total * greatest(0.5::DOUBLE, 0.75::DOUBLE - discount)")} AS fair_lot, {m("total * greatest(0.6::DOUBLE, 0.87::DOUBLE - discount)")} AS full_retail FROM d""")
def lot_summary_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderkey") % 100).alias("score"), (F.col("o_orderstatus") == "F").alias("bullion"))
    return lot_summary(o, ["o_custkey"], "o_totalprice", "score", "bullion")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS share FROM orders)
SELECT o_orderkey, floor(share * 1000 + 0.5) / 10 AS pct, CASE WHEN share > 0.5 THEN 'high' ELSE 'moderate' END AS risk FROM t WHERE share > 0.25""")
def concentration_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are over a quarter of what their customer bought."""
    total = F.sum(_cents("o_totalprice")).over(Window.partitionBy("o_custkey")).cast("double")
    t = table(spark, sf_dir, "orders").withColumn("share", F.col("o_totalprice") / total).where("share > 0.25")
    return t.select("o_orderkey", (F.floor(F.col("share") * 1000 + 0.5) / 10).alias("pct"), F.when(F.col("share") > 0.5, "high").otherwise("moderate").alias("risk"))


@query(f"""WITH h AS (SELECT o_custkey, l_quantity AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost, CAST({m("p_retailprice * l_quantity")} AS DECIMAL(18,2)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS items, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(value) AS DOUBLE) AS value, CAST(sum(value - cost) AS DOUBLE) AS unrealised FROM h GROUP BY 1""")
def portfolio_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by owner: items, cost, value and what would be won."""
    line, o, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    h = line.join(o, line.l_orderkey == o.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    value = money(F.col("p_retailprice") * F.col("l_quantity")).cast("decimal(18,2)")
    cost = _cents("l_extendedprice")
    return h.groupBy("o_custkey").agg(F.sum("l_quantity").cast("bigint").alias("items"), F.sum(cost).cast("double").alias("cost"), F.sum(value).cast("double").alias("value"), F.sum(value - cost).cast("double").alias("unrealised"))


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey > 20 THEN 'nation' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END], lambda x: x IS NOT NULL) AS gaps FROM customer")
def collection_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record lacks, as a list."""
    tests = [(F.col("c_acctbal") < 0, "balance"), (F.col("c_nationkey") > 20, "nation"), (F.col("c_mktsegment") == "MACHINERY", "segment")]
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])).alias("gaps"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as datasets: their orders are the comps."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("comp_count"), F.max("o_orderdate").cast("timestamp").alias("newest_sale"), F.min("o_orderdate").cast("timestamp").alias("oldest"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    shift = F.make_dt_interval((k % 100).cast("int"))
    return c.select("c_custkey", "c_mktsegment", "comp_count", "newest_sale", F.when(k % 3 != 0, as_of() - shift).alias("last_refresh"), F.when(k % 7 == 0, as_of() - shift).alias("no_data_at"), F.when(k % 7 == 0, k % 4).alias("no_data_count"), (k % 5).alias("refresh_count"), (k % 4).alias("last_new"), (k % 6).alias("dry"), (k % 2 == 0).alias("file_exists"))


FRESHNESS = f"""o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1),
s AS (SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n, newest, CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(newest)) / 86400000) AS BIGINT) AS age, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 END AS wait,
 CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 100 END AS nd, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 4 ELSE 0 END AS ndc, c_custkey % 5 AS rc, c_custkey % 4 AS ln, c_custkey % 6 AS dry, c_custkey % 2 = 0 AS fe FROM customer LEFT JOIN o ON c_custkey = o_custkey),
a AS (SELECT *, CASE WHEN n = 0 AND newest IS NULL THEN CASE WHEN fe THEN 'stale' ELSE 'missing' END WHEN age >= 30 THEN 'very-stale' WHEN age >= 15 THEN 'stale' WHEN age IS NOT NULL THEN 'fresh' ELSE 'stale' END AS freshness,
 CASE WHEN n = 0 AND NOT fe AND rc = 0 THEN 'untested' WHEN n = 0 THEN 'empty' WHEN n < 10 AND (rc >= 3 OR (rc >= 1 AND ln = 0)) THEN 'confirmed-thin' WHEN n < 10 THEN 'thin' ELSE 'viable' END AS depth, ndc >= 2 AND coalesce(nd < 60, false) AS dormant FROM s),
b AS (SELECT *, CASE WHEN dormant THEN 'dormant' WHEN depth = 'empty' THEN 'empty' WHEN depth = 'confirmed-thin' AND wait < 90 THEN 'confirmed-thin-skip' WHEN depth = 'thin' AND wait < 60 THEN 'thin-wait'
 WHEN depth = 'viable' AND freshness IN ('stale', 'very-stale') AND ((dry >= 4 AND wait < 60) OR (dry >= 2 AND wait < 30)) THEN 'dry-refresh-backoff' WHEN depth = 'viable' AND freshness IN ('stale', 'very-stale') AND wait < 14 THEN 'recently-confirmed-stale' END AS skip_reason FROM a),
c AS (SELECT *, CASE WHEN dormant OR depth = 'empty' THEN 'dormant' WHEN freshness = 'missing' AND depth = 'untested' THEN 'initial-fetch' WHEN depth = 'confirmed-thin' THEN CASE WHEN wait >= 90 THEN 'monitor-refresh' ELSE 'confirmed-thin-skip' END
 WHEN skip_reason IS NOT NULL THEN skip_reason WHEN depth = 'thin' THEN 'monitor-refresh' WHEN depth = 'viable' AND freshness IN ('stale', 'very-stale') THEN 'refresh' ELSE 'ok' END AS action FROM b),
f AS (SELECT *, CASE WHEN action = 'initial-fetch' THEN 'P2' WHEN action = 'monitor-refresh' THEN 'P3' WHEN action = 'refresh' AND freshness = 'very-stale' THEN 'P0' WHEN action = 'refresh' THEN 'P1' END AS priority FROM c)"""


@query(f"WITH {FRESHNESS} SELECT c_custkey, freshness, depth, skip_reason, action, priority FROM f")
def freshness_two_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.classified(datasets(spark, sf_dir), as_of()).select("c_custkey", "freshness", "depth", "skip_reason", "action", "priority")


@query(f"WITH {FRESHNESS} SELECT c_custkey, priority, age AS stale_days FROM f WHERE priority IS NOT NULL ORDER BY priority, age DESC NULLS FIRST, c_custkey LIMIT 50")
def refresh_priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = freshness.classified(datasets(spark, sf_dir), as_of())
    return freshness.refresh_queue(q, "c_custkey", 50).select("c_custkey", "priority", "stale_days")


@query(f"WITH {FRESHNESS} SELECT c_mktsegment, freshness, depth, count(*) AS n FROM f GROUP BY CUBE (c_mktsegment, freshness, depth)")
def freshness_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All roll-ups in one pass."""
    return freshness.classified(datasets(spark, sf_dir), as_of()).cube("c_mktsegment", "freshness", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1)
SELECT user_id, any_value(ok) AS last_success, count(*) FILTER (event_type = 'error' AND ts > coalesce(ok, TIMESTAMP '1970-01-01')) AS empties FROM events JOIN s USING (user_id) GROUP BY user_id""")
def dormancy_after_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success of each key."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok"))
    since = F.col("ok").isNull() | (F.col("ts") > F.col("ok"))
    return e.join(s, "user_id").groupBy("user_id").agg(F.max("ok").alias("last_success"), F.count_if((F.col("event_type") == "error") & since).alias("empties"))


@query("""WITH r AS (SELECT user_id, count(*) AS runs, count(*) FILTER (value < 20) AS short, floor(median(value) + 0.5) AS median FROM events GROUP BY 1)
SELECT user_id, runs, floor(short * 1000.0::DOUBLE / runs + 0.5) / 10 AS short_pct, median, CASE WHEN runs >= 5 AND short::DOUBLE / runs >= 0.8 THEN 'High' WHEN runs >= 3 AND short::DOUBLE / runs >= 0.5 THEN 'Medium' ELSE 'Low' END AS class FROM r""")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the runs of a key came back short, and how sure that is."""
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") < 20).alias("short"), F.floor(F.median("value") + 0.5).alias("median"))
    share = F.col("short") / F.col("runs")
    kind = F.when((F.col("runs") >= 5) & (share >= 0.8), "High").when((F.col("runs") >= 3) & (share >= 0.5), "Medium").otherwise("Low")
    return r.select("user_id", "runs", (F.floor(F.col("short") * 1000.0 / F.col("runs") + 0.5) / 10).alias("short_pct"), "median", kind.alias("class"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_quantity < 2 THEN 'quantity' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'status' END], lambda x: x IS NOT NULL) AS bad FROM lineitem)
SELECT rule, count(*) AS rows FROM (SELECT unnest(bad) AS rule FROM v) GROUP BY 1""")
def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules and how often."""
    tests = [(F.col("l_discount") > 0.09, "discount"), (F.col("l_quantity") < 2, "quantity"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "status")]
    bad = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))
    return table(spark, sf_dir, "lineitem").select(F.explode(bad).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS profile, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, avg(CAST(value AS DECIMAL(18,4))) AS pace FROM events GROUP BY 1),
w AS (SELECT max(n) FILTER (profile = 'a') AS na, max(n) FILTER (profile = 'b') AS nb, max(errors::DOUBLE / n) FILTER (profile = 'a') AS ea, max(errors::DOUBLE / n) FILTER (profile = 'b') AS eb, max(pace) FILTER (profile = 'a') AS pa, max(pace) FILTER (profile = 'b') AS pb FROM p)
SELECT na, nb, floor(ea * 10000 + 0.5) / 100 AS error_a, floor(eb * 10000 + 0.5) / 100 AS error_b, CASE WHEN pb <= 0.9 * pa AND eb <= ea THEN 'adopt' ELSE 'reject' END AS verdict FROM w""")
def ab_pilot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two profiles against each other; the second is adopted if it is a tenth faster and no worse."""
    p = table(spark, sf_dir, "events").groupBy(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("profile"))
    p = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg(F.col("value").cast("decimal(18,4)")).alias("pace"))

    def of(k: str, x):
        return F.max(F.when(F.col("profile") == k, x))

    rate = F.col("errors") / F.col("n")
    w = p.agg(of("a", F.col("n")).alias("na"), of("b", F.col("n")).alias("nb"), of("a", rate).alias("ea"), of("b", rate).alias("eb"), of("a", F.col("pace")).alias("pa"), of("b", F.col("pace")).alias("pb"))
    verdict = F.when((F.col("pb") <= F.col("pa") * 0.9) & (F.col("eb") <= F.col("ea")), "adopt").otherwise("reject")
    return w.select("na", "nb", (F.floor(F.col("ea") * 10000 + 0.5) / 100).alias("error_a"), (F.floor(F.col("eb") * 10000 + 0.5) / 100).alias("error_b"), verdict.alias("verdict"))


@query("SELECT quality, toxic, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def accuracy_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels against each other."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1, 2), p AS (SELECT *, lag(failed) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d)
SELECT user_id, count(*) AS days, count(*) FILTER (failed) AS failed_days, count(*) FILTER (failed <> before) AS flips FROM p GROUP BY 1""")
def flaky_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with failures and how often they come and go."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "error").alias("failed"))
    p = d.withColumn("before", F.lag("failed").over(Window.partitionBy("user_id").orderBy("day")))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.count_if("failed").alias("failed_days"), F.count_if(F.col("failed") != F.col("before")).alias("flips"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2)
SELECT user_id, day, used, greatest(0, 3 - used) AS remaining, CASE WHEN used >= 3 THEN 'exhausted' WHEN used * 100 >= 3 * 60 THEN 'warning' ELSE 'ok' END AS state FROM d""")
def daily_budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls a day against a limit of three."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    state = F.when(F.col("used") >= 3, "exhausted").when(F.col("used") * 100 >= 180, "warning").otherwise("ok")
    return d.withColumn("remaining", F.greatest(F.lit(0), 3 - F.col("used"))).withColumn("state", state)


@query("""WITH q AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
SELECT o_orderpriority, count(*) AS chosen, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS DOUBLE) AS total FROM q WHERE nth <= 40 GROUP BY 1""")
def queue_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest forty of each priority: how many and what they are worth."""
    nth = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    q = table(spark, sf_dir, "orders").withColumn("nth", nth).where("nth <= 40")
    return q.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("chosen"), F.sum(_cents("o_totalprice")).cast("double").alias("total"))


@query("SELECT label, count(*) AS n, len(any_value(embedding))::BIGINT AS dims FROM embeddings GROUP BY 1")
def embeddings_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.size(F.first("embedding")).cast("bigint").alias("dims"))


@query("SELECT * FROM (SELECT user_id, count(*) AS runs, min(ts) AS start_at, max(ts) AS end_at FROM events GROUP BY 1) ORDER BY end_at DESC, user_id LIMIT 20")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty runs that ended last."""
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.min("ts").alias("start_at"), F.max("ts").alias("end_at"))
    return r.orderBy(F.desc("end_at"), "user_id").limit(20)
