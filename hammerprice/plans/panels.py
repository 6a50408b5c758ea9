"""Matrices of all series at once, lists of stale data sets, a self-test of the look-up and findings about valuations, with SQL twins written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import freshness, health, panels, resolve
from ..registry import query, table
from .common import AS_OF, SALES, as_of, sales
from .operations import FRESHNESS, datasets

#: A series for each type of part, and a listing for each line of an order.
_SERIES = """CASE p_type WHEN 'ECONOMY' THEN 'Mexican Silver Libertad' WHEN 'LARGE' THEN 'Morgan Dollar' WHEN 'MEDIUM' THEN 'Silver Bar' WHEN 'PROMO' THEN 'Perth Lunar Series II Gold' WHEN 'SMALL' THEN 'American Gold Eagle' ELSE 'Franklin Half Dollar' END"""
_TITLE = """concat_ws(' ', concat(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 1960 + l_orderkey % 71 END, CASE l_linenumber WHEN 1 THEN '-D' WHEN 2 THEN ' S' WHEN 3 THEN 'CC' ELSE '' END), p_name,
CASE l_partkey % 5 WHEN 0 THEN 'MS69' WHEN 1 THEN 'pf-70' WHEN 2 THEN 'proof' WHEN 3 THEN 'MS 65+' END, CASE l_suppkey % 4 WHEN 0 THEN 'PAMP' WHEN 1 THEN 'credit suisse' WHEN 2 THEN 'perth mint' END, CASE l_orderkey % 6 WHEN 0 THEN '5 pesos' WHEN 1 THEN '10 pesos 1 oz' END)"""
_TYPE = "CASE l_orderkey % 4 WHEN 0 THEN 'FixedPrice' WHEN 1 THEN 'Auction' WHEN 2 THEN 'AuctionWithBIN' END"
_WANTED = "CASE p_type WHEN 'LARGE' THEN 'All' WHEN 'STANDARD' THEN 'proof' END"
_PRICE = "CASE WHEN l_orderkey % 11 = 0 THEN 0.0 ELSE CAST(floor(l_extendedprice) AS DOUBLE) END"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = {"series": _SERIES, "grade": _WANTED, "title": _TITLE, "sold": "l_quantity >= 10", "listing_type": _TYPE, "total": _PRICE, "url": "concat_ws('/', l_orderkey, l_linenumber)", "at": "CAST(l_shipdate AS TIMESTAMP)"}
    return line.join(part, line.l_partkey == part.p_partkey).select(*[F.expr(e).alias(n) for n, e in named.items()])


#: Days of sales that count.
_DAYS = 1500
_CELLS = f"""l AS (SELECT {_SERIES} AS series, p_type AS kind, {_TITLE} AS title, {_TYPE} AS listing_type, {_PRICE} AS total, concat_ws('/', l_orderkey, l_linenumber) AS url, l_quantity >= 10 AS sold, l_shipdate AS day,
 CASE WHEN l_orderkey % 13 <> 0 AND 1960 + l_orderkey % 71 < 2050 AND l_linenumber <> 3 THEN 1960 + l_orderkey % 71 END AS year, CASE l_linenumber WHEN 1 THEN 'D' WHEN 2 THEN 'S' ELSE 'P' END AS mint,
 CASE l_partkey % 5 WHEN 0 THEN 'MS69' WHEN 1 THEN 'PR70' WHEN 3 THEN 'MS65+' ELSE 'RAW' END AS own, l_partkey % 5 = 2 AS proof, CASE l_suppkey % 4 WHEN 0 THEN 'PAMP' WHEN 1 THEN 'Credit Suisse' WHEN 2 THEN 'Perth Mint' ELSE 'Generic' END AS brand, l_orderkey % 6 = 0 AS change
 FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT series, CASE kind WHEN 'MEDIUM' THEN 'brand' WHEN 'LARGE' THEN 'mint' WHEN 'STANDARD' THEN 'mint' ELSE 'grade' END AS mode, CASE WHEN kind <> 'MEDIUM' THEN year END AS year, CASE WHEN kind = 'MEDIUM' THEN brand WHEN kind IN ('LARGE', 'STANDARD') THEN mint ELSE own END AS axis, sold, CASE WHEN total > 0 THEN total END AS price, url
 FROM l WHERE (kind = 'MEDIUM' OR year IS NOT NULL) AND CASE WHEN sold THEN day BETWEEN CAST(TIMESTAMP '{AS_OF}' AS DATE) - {_DAYS} AND TIMESTAMP '{AS_OF}' ELSE listing_type IS NULL OR listing_type <> 'Auction' END
 AND CASE kind WHEN 'ECONOMY' THEN year >= 1982 AND NOT change WHEN 'PROMO' THEN year BETWEEN 2008 AND 2019 AND NOT change WHEN 'SMALL' THEN year >= 1986 AND NOT change WHEN 'STANDARD' THEN proof ELSE true END),
o AS (SELECT *, row_number() OVER (PARTITION BY series, year, axis ORDER BY price, url) AS nth FROM r WHERE NOT sold AND price IS NOT NULL),
c AS (SELECT series, mode, year, axis, floor(median(price) FILTER (sold) * 100 + 0.5) / 100 AS median, count(price) FILTER (sold) AS sold FROM r GROUP BY ALL),
p AS (SELECT c.*, a.price AS cheapest, a.url, b.price AS next_price, CASE WHEN c.series = 'Morgan Dollar' AND c.year = 1964 THEN 'key' WHEN c.series = 'Franklin Half Dollar' AND c.year = 1965 AND c.axis = 'S' THEN 'semi' WHEN c.series = 'Mexican Silver Libertad' THEN 'all' END AS tier
 FROM c LEFT JOIN o a ON a.nth = 1 AND a.series = c.series AND a.year IS NOT DISTINCT FROM c.year AND a.axis = c.axis LEFT JOIN o b ON b.nth = 2 AND b.series = c.series AND b.year IS NOT DISTINCT FROM c.year AND b.axis = c.axis)"""


@query(f"WITH {_CELLS} SELECT * FROM p")
def market_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of all series: medians of sales, the two lowest offers, key dates."""
    dates = spark.sql("SELECT * FROM VALUES (0, 'Morgan Dollar', 1964, '*', 'key'), (1, 'Franklin Half Dollar', 1965, 'S', 'semi'), (2, 'Mexican Silver Libertad', 0, '*', 'all') AS t(nth, series, year, mint, tier)")
    return panels.panels(listings(spark, sf_dir), as_of(), _DAYS, dates)


@query(f"""WITH {_CELLS} SELECT series, mode, CASE series WHEN 'Mexican Silver Libertad' THEN 'Mexico Silver Libertad 1 oz' WHEN 'Perth Lunar Series II Gold' THEN 'Perth Lunar Series II gold 1 oz' WHEN 'American Gold Eagle' THEN 'American Gold Eagle 1 oz' WHEN 'Franklin Half Dollar' THEN 'Franklin Half Dollar Proof' ELSE series END AS keywords,
count(*) AS cells, count(*) FILTER (median IS NOT NULL OR cheapest IS NOT NULL) AS priced, min(year) AS first_year, max(year) AS last_year, count(DISTINCT axis) AS columns FROM p GROUP BY series, mode""")
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' matrix in a row, and the words that are searched for."""
    wanted = F.when(F.col("series") == "Franklin Half Dollar", "proof")
    out = panels.panel_summaries(panels.panels(listings(spark, sf_dir), as_of(), _DAYS)).withColumn("keywords", panels.keywords(F.col("series"), F.lit(None).cast("double"), wanted))
    return out.select("series", "mode", "keywords", "cells", "priced", "first_year", "last_year", "columns")


@query(f"WITH {FRESHNESS}, u AS (SELECT coalesce(skip_reason, 'actionable') AS reason, freshness IN ('stale', 'very-stale') OR newest IS NULL AS old FROM f) SELECT reason, count(*) AS n, count(*) FILTER (old) AS stale FROM u GROUP BY 1")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets by why a refresh leaves them out, and how many of them are stale."""
    return freshness.skip_counts(freshness.classified(datasets(spark, sf_dir), as_of()))


@query(f"""WITH {FRESHNESS}, top AS (SELECT c_mktsegment || ' (' || c_custkey || ')' AS term, age, c_custkey FROM f WHERE skip_reason IS NULL AND (age >= 30 OR newest IS NULL) ORDER BY age DESC NULLS FIRST, c_custkey LIMIT 40)
SELECT count(*) AS n, string_agg('^' || replace(replace(term, '(', '\\('), ')', '\\)') || '$', '|' ORDER BY age DESC NULLS FIRST, c_custkey) AS pattern FROM top""")
def stale_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty stalest data sets that are worth a refresh as one filter for file names."""
    rows = freshness.classified(datasets(spark, sf_dir), as_of()).withColumn("term", F.concat("c_mktsegment", F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")")))
    return freshness.stale_pattern(rows, "term", "c_custkey", days=30, limit=40)


#: Data sets whose words the canonical key leaves as they are, and the ways to ask for them.
_SET = """concat_ws(' ', CASE p_size % 4 WHEN 0 THEN '1964-d' WHEN 1 THEN '1964' WHEN 2 THEN '1881-cc' END, p_name, CASE p_size % 3 WHEN 0 THEN 'morgan' WHEN 1 THEN 'franklin half' END, CASE WHEN p_size % 5 = 0 THEN 'proof' END)"""
_WORDS = "list_filter(list_distinct(string_split(replace({0}, '-', ' '), ' ')), lambda x: length(x) > 1)"
_SAYS = "regexp_extract({0}, '^(1964|1881)', 1) AS y, regexp_extract({0}, '^[0-9]+-([a-z]+) ', 1) AS mk, {0} LIKE '%proof%' AS special, " + _WORDS + " AS w"


@query(f"""WITH k AS (SELECT min(p_partkey) AS key_id, t AS term FROM (SELECT p_partkey, {_SET} AS t FROM part) GROUP BY t), d AS (SELECT key_id, term, {_SAYS.format("term")} FROM k),
v AS (SELECT key_id AS own, unnest(list_distinct(list_filter([term, CASE WHEN y <> '' AND term LIKE '%half%' AND term NOT LIKE '%dollar%' THEN term || ' dollar' END, CASE WHEN y <> '' AND term LIKE '%morgan%' THEN replace(term, 'morgan', 'morgan dollar') END, CASE WHEN y <> '' AND term LIKE '%morgan%' THEN term || ' dollar' END,
 CASE WHEN y <> '' AND mk = '' THEN y || '-d' || substr(term, 5) END, CASE WHEN y <> '' AND mk = '' THEN y || '-s' || substr(term, 5) END, CASE WHEN y <> '' AND term LIKE '% half' THEN term || ' dollar' END], lambda x: x IS NOT NULL))) AS asked, y AS expected FROM d),
q AS (SELECT own, asked, expected, {_SAYS.format("asked")} FROM v),
p AS (SELECT own, asked, expected, d.key_id, d.y AS dy, (len(list_intersect(q.w, d.w)) / len(d.w) + len(list_intersect(q.w, d.w)) / len(q.w)) / 2 AS c, greatest(len(list_intersect(q.w, d.w)) / len(d.w), len(list_intersect(q.w, d.w)) / len(q.w)) AS g, q.y AS qy, q.mk AS qm, d.mk AS dm FROM q, d
 WHERE NOT (q.y <> '' AND d.y <> '' AND q.y <> d.y) AND NOT (d.special AND NOT q.special)),
s AS (SELECT *, round(c + CASE WHEN qm <> '' AND qm = dm THEN 0.2::DOUBLE WHEN qm <> '' AND dm <> '' THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN qy <> '' AND qy = dy THEN 0.2::DOUBLE ELSE 0 END, 9) AS score FROM p WHERE g >= 0.65::DOUBLE AND c > 0.55::DOUBLE),
b AS (SELECT own, asked, arg_min(key_id, (-score, key_id)) AS found, arg_min(dy, (-score, key_id)) AS got FROM s GROUP BY 1, 2)
SELECT own AS key_id, q.asked, b.found, CASE WHEN b.found IS NULL THEN 'no match' WHEN q.expected <> '' AND b.got <> '' AND b.got <> q.expected THEN 'wrong year' WHEN b.found = own THEN 'same' ELSE 'other' END AS outcome FROM q LEFT JOIN b USING (own, asked)""")
def lookup_self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data set asked for in all the ways that people do, and what the look-up finds."""
    part = table(spark, sf_dir, "part")
    keys = part.select("p_partkey", F.expr(_SET).alias("term")).groupBy("term").agg(F.min("p_partkey").alias("key_id"))
    return resolve.self_test(keys)


_VALUED = f"""{SALES}, v AS (SELECT part_key, any_value(name) AS name, CASE WHEN part_key % 23 = 0 THEN 'timeout' END AS error, CASE WHEN part_key % 19 <> 0 THEN median(price) END AS fmv, count(*) AS comps, count(*) FILTER (quantity < 10) * 100.0::DOUBLE / count(*) AS attrition,
 CASE WHEN part_key % 7 <> 0 THEN 900.0::DOUBLE + part_key % 40 END AS melt, CASE WHEN part_key % 3 <> 0 THEN part_key % 40 / 31.1035::DOUBLE END AS weight FROM sales GROUP BY part_key)"""


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part_key")
    v = sales(spark, sf_dir).groupBy("part_key").agg(F.first("name").alias("name"), F.median("price").alias("fmv"), F.count(F.lit(1)).alias("comps"), (F.count_if(F.col("quantity") < 10) * 100.0 / F.count(F.lit(1))).alias("attrition"))
    return v.withColumns({"error": F.when(k % 23 == 0, "timeout"), "fmv": F.when(k % 19 != 0, F.col("fmv")), "melt": F.when(k % 7 != 0, k % 40 + 900.0), "weight": F.when(k % 3 != 0, k % 40 / 31.1035), "grams": k % 41, "low": F.lit(905.0), "high": F.lit(1500.0)})


@query(f"""WITH {_VALUED}, i AS (SELECT part_key, CASE WHEN error IS NOT NULL THEN ['RED:request-error'] WHEN fmv IS NULL THEN ['RED:no-fmv'] ELSE list_filter([CASE WHEN comps < 3 THEN 'YELLOW:low-data' END, CASE WHEN comps < 5 THEN 'YELLOW:thin-comps' END, CASE WHEN attrition > 90 THEN 'RED:high-attrition' WHEN attrition > 70 THEN 'YELLOW:attrition' END,
 CASE WHEN fmv / melt - 1 < 0.02::DOUBLE THEN 'YELLOW:premium-low' WHEN fmv / melt - 1 > 0.1::DOUBLE THEN 'YELLOW:premium-high' END], lambda x: x IS NOT NULL) END AS found FROM v)
SELECT part_key, array_to_string(found, ',') AS findings, CASE WHEN array_to_string(found, ',') LIKE '%RED%' THEN 'RED' WHEN len(found) > 0 THEN 'YELLOW' ELSE 'GREEN' END AS rating FROM i""")
def valuation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each part's valuation, and how badly."""
    v = valued(spark, sf_dir)
    found = health.findings(F.col("error"), F.col("fmv"), F.col("comps") < 3, F.col("comps"), F.col("attrition"), F.col("melt"), F.lit(0.02), F.lit(0.1))
    v = v.withColumn("found", found)
    return v.select("part_key", F.array_join("found", ",").alias("findings"), health.rating(F.col("found")).alias("rating"))


@query(f"""WITH {_VALUED} SELECT part_key, array_to_string(list_filter([CASE WHEN weight IS NULL OR abs(weight - part_key % 41 / 31.1035::DOUBLE) > 0.001::DOUBLE THEN 'weight' END, CASE WHEN fmv IS NULL OR fmv < 905 OR fmv > 1500 THEN 'range' END, CASE WHEN fmv < melt * 0.9::DOUBLE THEN 'melt' END, CASE WHEN comps = 0 THEN 'comps' END], lambda x: x IS NOT NULL), ',') AS failed FROM v""")
def bar_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a bar's valuation that fail: weight, range, melt value, comps."""
    failed = health.failed_checks(F.col("weight"), F.col("grams"), F.col("fmv"), F.col("low"), F.col("high"), F.col("melt"), F.col("comps"))
    return valued(spark, sf_dir).select("part_key", F.array_join(failed, ",").alias("failed"))


@query(f"""WITH {_VALUED}, g AS (SELECT name AS term, count(fmv) AS n, min(fmv) AS low, max(fmv) AS high FROM v GROUP BY name HAVING count(*) > 1 AND count(fmv) > 1)
SELECT term, n, low, high, floor((high - low) / high * 10000 + 0.5) / 100 AS delta FROM g WHERE high > 0 AND (high - low) / high > 0.05::DOUBLE""")
def unstable_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that were valued several times, with values over five per cent apart."""
    return health.unstable(valued(spark, sf_dir), "name", "fmv").withColumnRenamed("name", "term")
