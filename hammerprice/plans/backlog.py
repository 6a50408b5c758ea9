"""Budgets, quotas, backlogs, pilots and stores of unknown shape, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pilot, ranks
from ..registry import query, table
from ..sources import stores

#: What a queue may cost, and how many of each kind a mixed choice takes: the features' own limits.
BUDGET, FIXED, EXTRA = 20_000_000, 120, 300


@query(f"""WITH r AS (SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_orderkey, place, CAST(total AS DOUBLE) AS total FROM r WHERE total <= {BUDGET}""")
def budgeted_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent orders, by priority and age over all, as long as their sum fits into the budget."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    out = ranks.take_while(rows, ["o_orderpriority", "o_orderdate", "o_orderkey"], F.col("cost"), BUDGET)
    return out.select("o_orderkey", "place", F.col("total").cast("double").alias("total"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM orders")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and running total of every order by date."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ranks.prefix_sums(rows, ["o_orderdate", "o_orderkey"], F.col("o_totalprice").cast("decimal(18,2)")).select("o_orderkey", "place", F.col("total").cast("double").alias("total"))


@query(f"""WITH a AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderdate, o_orderkey LIMIT {FIXED}), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%')
SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b WHERE n <= {FIXED + EXTRA} - (SELECT count(*) FROM a)""")
def mixed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many urgent orders and so many others, the oldest of each."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return ranks.mixed_quota(rows, F.col("o_orderpriority").startswith("1"), ["o_orderdate", "o_orderkey"], FIXED, EXTRA).select("o_orderkey")


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '-' || p_type WHEN 1 THEN p_type || ' ' || p_name ELSE p_name || '  ' || p_brand END AS key, CASE p_partkey % 7 WHEN 0 THEN 'dormant' WHEN 1 THEN 'needs-data' ELSE 'refresh' END AS action,
  CASE p_size % 6 WHEN 0 THEN 'P0.1' WHEN 1 THEN 'P0' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' WHEN 4 THEN 'P9' END AS priority, CASE WHEN p_partkey % 3 > 0 THEN p_name || ' (' || p_type || ') & co' END AS term FROM part),
f AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || lower(p_type) || '.csv' AS file FROM part WHERE length(p_name) > 7),
w AS (SELECT file, array_to_string(list_sort(list_distinct(string_split(replace(replace(file, '.csv', ''), '_', ' '), ' '))), ' ') AS words FROM f),
g AS (SELECT words, max(file) AS file FROM w GROUP BY words),
k AS (SELECT *, array_to_string(list_sort(list_filter(list_distinct(string_split(replace(lower(key), '-', ' '), ' ')), lambda x: x <> '')), ' ') AS words FROM d WHERE action <> 'dormant' AND coalesce(priority, '') <> 'P2' AND (priority IN ('P0.1', 'P0', 'P1', 'P2') OR priority IS NULL AND action = 'needs-data'))
SELECT p_partkey, key, coalesce(g.file, left(replace(regexp_replace(coalesce(term, key), '[^\\w\\s-]', '', 'g'), ' ', '_'), 80) || '.csv') AS file, g.file IS NULL AS is_new FROM k LEFT JOIN g ON g.words = k.words""")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be refreshed, and in which file: one that has the same words, or a new one."""
    part = table(spark, sf_dir, "part")
    datasets = part.select(
        "p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '-' || p_type WHEN 1 THEN p_type || ' ' || p_name ELSE p_name || '  ' || p_brand END").alias("key"),
        F.array(F.expr("CASE p_partkey % 7 WHEN 0 THEN 'dormant' WHEN 1 THEN 'needs-data' ELSE 'refresh' END")).alias("actions"),
        F.expr("CASE p_size % 6 WHEN 0 THEN 'P0.1' WHEN 1 THEN 'P0' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' WHEN 4 THEN 'P9' END").alias("priority"),
        F.when(F.col("p_partkey") % 3 > 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(") & co"))).alias("search_term"),
    )
    files = part.where(F.length("p_name") > 7).select(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.lower("p_type"), F.lit(".csv")).alias("file")).distinct()
    return ranks.backlog(datasets, files, ["P0.1", "P0", "P1", "P2"], exclude=["P2"], carried=["p_partkey"])


_PASS = """SELECT user_id * 1000 + floor((number - 1) / size)::BIGINT AS pilot_id, event_id AS run_id, ts AS made, CASE WHEN event_id % 29 = 0 THEN 'Elevated' ELSE 'Normal' END AS state_before, CASE WHEN event_type = 'error' AND user_id % 3 = 0 AND event_id % 2 = 0 THEN 'Cooldown' WHEN event_type = 'error' AND event_id % 8 = 1 THEN 'Elevated' ELSE 'Normal' END AS state_after,
CASE WHEN s = 1 THEN 'normal-tuned' ELSE 'baseline' END AS profile, CASE WHEN s = 1 THEN 70.0 ELSE 100.0 END + value / 10 + CASE WHEN user_id % 5 = 0 THEN 60 * s ELSE 0 END AS duration, 10 AS attempted, 8 - CASE WHEN user_id % 7 = 0 THEN s ELSE 0 END AS succeeded, 1 + CASE WHEN user_id % 7 = 0 THEN s ELSE 0 END AS failed, 1 AS empty, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS unknown, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS challenges, 0 AS no_export, CASE WHEN user_id % 13 = 0 THEN event_type ELSE 'm' END AS machine
FROM (SELECT *, CASE WHEN (number - 1) % size + 1 IN (2, 3, 5, 8, 9, 11) THEN 1 WHEN (number - 1) % size = 6 AND user_id % 4 = 0 THEN 1 ELSE 0 END AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, CASE WHEN user_id % 9 = 0 THEN 13 ELSE 12 END AS size FROM events))"""
_RATES = ", ".join(f"sum({c}) FILTER (tuned = {w}) / sum(attempted) FILTER (tuned = {w}) AS {n}{w}" for w in (0, 1) for c, n in (("duration", "pace"), ("succeeded", "su"), ("failed", "fa"), ("unknown", "un"), ("no_export", "ne"), ("challenges", "ch")))


@query(f"""WITH p AS ({_PASS}), j AS (SELECT *, state_before <> 'Normal' OR succeeded + failed + empty + unknown <> attempted AS bad, CASE WHEN profile = 'normal-tuned' THEN 1 ELSE 0 END AS tuned FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY pilot_id ORDER BY made, run_id) AS nth FROM j WHERE NOT bad), u AS (SELECT *, tuned <> [0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 1, 0][nth] AS wrong FROM g WHERE nth <= 12),
x AS (SELECT pilot_id, count(*) FILTER (bad) AS problems, count(*) FILTER (NOT bad) AS good FROM j GROUP BY 1),
s AS (SELECT pilot_id, count(*) AS passes, min(nth) FILTER (wrong) AS w, count(DISTINCT machine) > 1 AS mixed, {_RATES}, avg((state_after = 'Elevated')::INT) FILTER (tuned = 0) AS el0, avg((state_after = 'Elevated')::INT) FILTER (tuned = 1) AS el1, avg((state_after = 'Cooldown')::INT) FILTER (tuned = 0) AS co0, avg((state_after = 'Cooldown')::INT) FILTER (tuned = 1) AS co1 FROM u GROUP BY 1),
o AS (SELECT x.pilot_id, coalesce(passes, 0) AS passes, problems, greatest(good - 12, 0) AS surplus, coalesce(w, CASE WHEN coalesce(passes, 0) < 12 THEN coalesce(passes, 0) + 1 END) AS break_at, coalesce(mixed, false) AS mixed, floor((pace0 - pace1) / pace0 * 10000 + 0.5) / 100 AS faster_pct, s.* EXCLUDE (pilot_id, passes, mixed) FROM x LEFT JOIN s ON s.pilot_id = x.pilot_id)
SELECT pilot_id, passes, problems, surplus, break_at, mixed, faster_pct, CASE WHEN NOT (break_at IS NULL AND surplus = 0 AND problems = 0 AND NOT mixed) THEN 'insufficient-data' WHEN greatest(ch0, ch1, co0, co1) > 0 THEN 'reject'
 WHEN faster_pct >= 10 AND su1 >= su0 AND fa1 <= fa0 AND un1 <= un0 AND ne1 <= ne0 AND ch1 <= ch0 AND el1 <= el0 AND co1 <= co0 THEN 'adopt' ELSE 'retain-baseline' END AS recommendation FROM o""")
def pilot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, twelve or thirteen at a time, as the passes of pilots: their order, the profiles' rates, a recommendation."""
    nth = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", nth.alias("nth"), F.when(F.col("user_id") % 9 == 0, 13).otherwise(12).alias("size"))
    place = F.col("nth") % F.col("size") + 1
    e = e.withColumn("s", F.when(place.isin(2, 3, 5, 8, 9, 11), 1).when((place == 7) & (F.col("user_id") % 4 == 0), 1).otherwise(0))
    profile = F.when(F.col("s") == 1, pilot.TUNED).otherwise(pilot.BASELINE)
    u = F.col("user_id")
    worse = F.when(u % 7 == 0, F.col("s")).otherwise(0)
    error = F.col("event_type") == "error"
    passes = e.select(
        (u * 1000 + F.floor(F.col("nth") / F.col("size"))).alias("pilot_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 29 == 0, "Elevated").otherwise("Normal").alias("state_before"), F.when(error & (u % 3 == 0) & (F.col("event_id") % 2 == 0), "Cooldown").when(error & (F.col("event_id") % 8 == 1), "Elevated").otherwise("Normal").alias("state_after"),
        profile.alias("requested"), profile.alias("effective"), (F.when(F.col("s") == 1, 70.0).otherwise(100.0) + F.col("value") / 10 + F.when(u % 5 == 0, F.col("s") * 60).otherwise(0)).alias("duration"),
        F.lit(10).alias("attempted"), (8 - worse).alias("succeeded"), (1 + worse).alias("failed"), F.lit(1).alias("empty"), F.when(F.col("event_id") % 31 == 0, 1).otherwise(0).alias("unknown"), F.when(u % 11 == 0, 1).otherwise(0).alias("challenges"), F.lit(0).alias("no_export"),
        F.when(u % 13 == 0, F.col("event_type")).otherwise("m").alias("machine"),
    )
    return pilot.report(passes, "at", ["machine"])


_STORE = """'{"' || event_type || '": {"t' || user_id % 3 || '": {"' || (1990 + event_id % 9) || '": ' || props || ', "note": "x", "' || (2000 + user_id % 5) || '": {"P": ' || (90 + event_id % 50) || ', "S": null, "x": [1]}}}, "bad": ' || event_id || '}'"""


@query(rf"""WITH e AS (SELECT event_id AS nth, event_type AS category, 't' || user_id % 3 AS kind, 1990 + event_id % 9 AS y1, 2000 + user_id % 5 AS y2, CAST(regexp_extract(props, ': (\d+)', 1) AS BIGINT) AS n1, 90 + event_id % 50 AS n2 FROM events),
l AS (SELECT nth, category, kind, y1 AS year, n1 AS number FROM e UNION ALL SELECT nth, category, kind, y2, n2 FROM e)
SELECT number, arg_min(category, (nth, year)) AS category, arg_min(year, (nth, year)) AS year FROM l WHERE number > 50 GROUP BY number""")
def catalogue_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in nested stores of unknown shape, with the category and year where each is first seen."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("nth"), F.expr(_STORE).alias("text"))
    leaves = stores.walked(rows, "text", ["category", "kind", "year", "mint"], "number")
    return stores.catalogue(leaves, least=50)


_KEY = """concat_ws(' ', CASE p_partkey % 5 WHEN 0 THEN 'Canadian' WHEN 1 THEN 'silver' WHEN 2 THEN 'Gold' END, CASE p_partkey % 13 WHEN 0 THEN 'maple leaf' WHEN 1 THEN 'krugerrand' WHEN 2 THEN 'Libertad' WHEN 3 THEN 'panda' WHEN 4 THEN 'eagle' WHEN 5 THEN 'lunar' WHEN 6 THEN 'bar' WHEN 7 THEN 'buffalo' ELSE p_name END, CASE p_partkey % 7 WHEN 0 THEN 'generic' WHEN 1 THEN 'generic x' END)"""
_DEPTH = "CASE p_size % 3 WHEN 0 THEN 'thin' ELSE 'viable' END"


@query(rf"""WITH k AS (SELECT p_partkey, p_partkey % 5 AS a, p_partkey % 13 AS b, {_KEY} AS key, 1960 + p_size AS year, {_DEPTH} AS depth, CASE WHEN p_size % 2 = 0 THEN 'bullion-proof' ELSE 'bar' END AS made, CASE WHEN p_partkey % 3 = 0 THEN 'gold' ELSE 'silver' END AS metal, CASE p_partkey % 4 WHEN 0 THEN ' Semiquincentennial Dime ' WHEN 1 THEN 'semiquincentennial clad half' ELSE 'dime' END AS coin FROM part)
SELECT p_partkey, b IN (0, 1, 2, 3, 5) OR b = 4 AND a IN (1, 2) OR b = 6 AND a IN (1, 2) OR b = 7 AND a IN (1, 2) AS bullion, b = 6 AND a IN (1, 2) AS bar,
coalesce(year < CASE WHEN b = 0 THEN 1979 WHEN b = 1 THEN 1967 WHEN b IN (2, 3) THEN 1982 WHEN b = 4 AND a IN (1, 2) THEN 1986 WHEN b = 7 AND a = 2 THEN 2006 END, false) AS too_early,
CASE WHEN b = 1 THEN CASE WHEN a = 1 THEN 'Silver Krugerrand' ELSE 'Gold Krugerrand' END WHEN b = 4 THEN CASE a WHEN 1 THEN 'American Silver Eagle' WHEN 2 THEN 'American Gold Eagle' END WHEN b = 7 AND a = 2 THEN 'American Gold Buffalo' WHEN b = 0 THEN CASE a WHEN 1 THEN 'Canadian Silver Maple Leaf' WHEN 2 THEN 'Canadian Gold Maple Leaf' END
 WHEN b = 3 THEN CASE a WHEN 1 THEN 'Chinese Silver Panda' WHEN 2 THEN 'Chinese Gold Panda' END WHEN b = 2 THEN CASE a WHEN 1 THEN 'Mexican Silver Libertad' WHEN 2 THEN 'Mexican Gold Libertad' END WHEN b = 5 THEN CASE a WHEN 2 THEN 'Gold Lunar' ELSE 'Silver Lunar' END END AS series,
CASE p_partkey % 4 WHEN 0 THEN 'Roosevelt Dime' WHEN 1 THEN 'Kennedy Half Dollar' END AS anniversary, p_partkey % 7 = 0 AS generic, depth = 'viable' AND metal = 'silver' AND made = 'bullion-proof' AND (b IN (0, 2, 3) OR b = 4 AND a = 1) AS fast FROM k""")
def key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of key each is: bullion, a bar, older than its series, of which series, generic, in the fast lane."""
    from ..operators import classes

    key, coin = F.col("key"), F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Semiquincentennial Dime ' WHEN 1 THEN 'semiquincentennial clad half' ELSE 'dime' END")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KEY).alias("key"), (F.col("p_size") + 1960).alias("year"), F.expr(_DEPTH).alias("depth"), F.when(F.col("p_size") % 2 == 0, "bullion-proof").otherwise("bar").alias("made"), F.when(F.col("p_partkey") % 3 == 0, "gold").otherwise("silver").alias("metal"), coin.alias("coin"))
    columns = {
        "bullion": classes.bullion_series(key), "bar": classes.bar_series(key), "too_early": classes.too_early(key, F.col("year")), "series": classes.premium_series(key), "anniversary": classes.anniversary_series(F.col("coin")),
        "generic": classes.generic_key(key), "fast": classes.fast_lane(key, F.col("made"), F.col("metal"), F.col("depth")),
    }
    return rows.select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN lower(p_type) || '_mexican_' || p_name ELSE p_brand || ' ' || p_name END AS key FROM part),
f AS (SELECT DISTINCT array_to_string(list_sort(string_split(CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE 'mexico ' || p_name || ' ' || lower(p_type) END, ' ')), ' ') AS words FROM part WHERE length(p_name) > 7)
SELECT p_partkey, EXISTS (SELECT 1 FROM f WHERE f.words = array_to_string(list_sort(string_split(replace(replace(lower(key), '_', ' '), 'mexican', 'mexico'), ' ')), ' ')) AS has_file FROM k""")
def keys_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each key has a file: under its canonical form or the same words."""
    from ..operators import classes

    part = table(spark, sf_dir, "part")
    keys = part.select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN lower(p_type) || '_mexican_' || p_name ELSE p_brand || ' ' || p_name END").alias("key"))
    files = part.where(F.length("p_name") > 7).select(F.concat(F.translate(F.expr("CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE 'mexico ' || p_name || ' ' || lower(p_type) END"), " ", "_"), F.lit(".csv")).alias("file")).distinct()
    return classes.with_file(keys, files).drop("key")
