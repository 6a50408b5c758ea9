"""Titles taken apart, searches put together, and look-ups by ladder and interval, with SQL twins written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, intervals, ladders, title
from ..registry import query, table

#: A title for each part: pieces follow numbers without a common factor, so that most of their combinations occur.
_YEAR = "CASE p_partkey % 7 WHEN 0 THEN '1921' WHEN 1 THEN '1960-D' WHEN 2 THEN '2021 w' WHEN 3 THEN '1881CC' WHEN 4 THEN '1699' WHEN 5 THEN '2031 S' END"
_NAME = """CASE p_partkey % 29 WHEN 0 THEN 'Morgan Dollar' WHEN 1 THEN 'American Silver Eagle' WHEN 2 THEN 'Year of the Dragon Perth Lunar silver' WHEN 3 THEN 'St. Gaudens double eagle' WHEN 4 THEN 'wedge-tailed eagle'
WHEN 5 THEN 'Canadian Gold Maple Leaf' WHEN 6 THEN 'Mexican gold Libertad' WHEN 7 THEN 'base metal token' WHEN 8 THEN 'walking liberty half' WHEN 9 THEN 'seated  liberty dime' WHEN 10 THEN 'Quarters' WHEN 11 THEN 'Year Of The Ox'
WHEN 12 THEN 'semiquincentennial $2.50' WHEN 13 THEN 'buffalo nickel D' WHEN 14 THEN 'Gold Buffalo' WHEN 15 THEN 'palladium eagle' WHEN 16 THEN 'Chinese panda gold silver' WHEN 17 THEN 'half dollar' WHEN 18 THEN 'eagle' WHEN 19 THEN 'British lunar platinum' ELSE p_name END"""
_GRADE = """CASE p_partkey % 17 WHEN 0 THEN 'MS65' WHEN 1 THEN 'pr-70+' WHEN 2 THEN 'EF 40' WHEN 3 THEN 'Gem BU' WHEN 4 THEN 'very fine' WHEN 5 THEN 'Fine Silver' WHEN 6 THEN 'choice  bu' WHEN 7 THEN 'About Uncirculated' WHEN 8 THEN 'good luck' WHEN 9 THEN 'ms 7'
WHEN 10 THEN 'MS655' WHEN 11 THEN 'superb gem bu' WHEN 12 THEN 'good' WHEN 13 THEN 'F-12' END"""
_FINISH = """CASE p_partkey % 19 WHEN 0 THEN 'Reverse Proof' WHEN 1 THEN 'proof' WHEN 2 THEN 'Proof-Like PL' WHEN 3 THEN 'burnished' WHEN 4 THEN 'uncirculated set' WHEN 5 THEN 'silver proof set' WHEN 6 THEN 'Mint Set' WHEN 7 THEN 'coloured' WHEN 8 THEN 'High  Relief proof'
WHEN 9 THEN 'Prestige Proof Set' WHEN 10 THEN 'Uncirculated' WHEN 11 THEN 'DCAM' WHEN 12 THEN 'clad proof set' WHEN 13 THEN 'enhanced reverse proof' WHEN 14 THEN 'UNC' END"""
_WEIGHT = """CASE p_partkey % 11 WHEN 0 THEN '1/2 oz' WHEN 1 THEN '1.5 troy oz' WHEN 2 THEN 'quarter ounce' WHEN 3 THEN '.5g' WHEN 4 THEN '30 grams' WHEN 5 THEN 'half gram' WHEN 6 THEN '10oz' WHEN 7 THEN '1/10oz' WHEN 8 THEN '0 oz 5 g' END"""
_MORE = "CASE p_partkey % 13 WHEN 0 THEN '-gold' WHEN 1 THEN 'roll' WHEN 2 THEN 'Type 2' WHEN 3 THEN 'S mint -proof -set' WHEN 4 THEN '20 coin roll' WHEN 5 THEN 'mint mark: o' WHEN 6 THEN 'cc' WHEN 7 THEN 'copper' END"
_TITLE = f"concat_ws(' ', {_YEAR}, {_NAME}, {_GRADE}, {_FINISH}, {_WEIGHT}, {_MORE})"

#: The parser in DuckDB. Names that can't occur in these titles are left out of its list.
_PARSED = rf"""t AS (SELECT p_partkey, {_TITLE} AS title FROM part),
b AS (SELECT *, regexp_extract_all(lower(title), '(?:^|\s)-(\w+)', 1) AS exclusions, trim(regexp_replace(regexp_replace(title, '(^|\s)-\w+', ' ', 'g'), '\s\s+', ' ', 'g')) AS plain FROM t),
c AS (SELECT *, lower(plain) AS low FROM b),
g AS (SELECT *, nullif(regexp_extract(low, '\b(ms|pr|pf|sp|au|xf|ef|vf|f|vg|g|ag|po)\s*-?\s*(\d{{1,2}})(\+?)(?:\W|$)', 1), '') AS pre, regexp_extract(low, '\b(ms|pr|pf|sp|au|xf|ef|vf|f|vg|g|ag|po)\s*-?\s*(\d{{1,2}}\+?)(?:\W|$)', 2) AS num,
  regexp_extract(low, '\b(superb\s+gem\s+bu|gem\s+bu|choice\s+bu|bu|unc)\b', 1) AS bu FROM c),
h AS (SELECT *, CASE WHEN pre IS NOT NULL THEN CASE pre WHEN 'pf' THEN 'PR' WHEN 'ef' THEN 'XF' ELSE upper(pre) END || num WHEN bu LIKE 'superb%' THEN 'MS67' WHEN bu LIKE 'gem%' THEN 'MS65' WHEN bu LIKE 'choice%' THEN 'MS63' WHEN bu <> '' THEN 'MS60'
  WHEN low LIKE '%about uncirculated%' THEN 'AU50' WHEN low LIKE '%very fine%' THEN 'VF20' WHEN regexp_matches(low, '\w good( |$)') AND low NOT LIKE '%good luck%' THEN 'G4' END AS g0,
  CASE WHEN pre IS NOT NULL THEN NULL WHEN bu <> '' THEN 'bu-term' ELSE 'word-grade' END AS s0,
  CASE WHEN low LIKE '%enhanced reverse proof%' THEN 'Enhanced Reverse Proof' WHEN low LIKE '%reverse proof%' THEN 'Reverse Proof' WHEN low LIKE '%burnished%' THEN 'Burnished' WHEN low LIKE '%high relief%' THEN 'High Relief' WHEN low LIKE '%coloured%' THEN 'Colorized'
    WHEN low LIKE '%uncirculated%' AND NOT (low LIKE '%uncirculated set%' AND low NOT LIKE '%about uncirculated%') THEN 'Uncirculated' END AS f0,
  CASE WHEN low LIKE '%prestige proof set%' THEN 'prestige' WHEN low LIKE '%silver proof set%' THEN 'silver' WHEN low LIKE '%proof set%' THEN 'clad' WHEN low LIKE '%mint set%' OR low LIKE '%uncirculated set%' THEN 'mint-uncirculated' END AS set_type FROM g),
k AS (SELECT *, set_type IS NULL AND f0 IS NULL AND regexp_matches(low, '\bproof\b') AND low NOT LIKE '%proof-like%' AND (g0 IS NULL OR coalesce(s0 = 'bu-term', false)) AS struck,
  regexp_extract(low, '\b(\d+(?:\.\d+)?(?:/\d+)?)\s*(?:troy\s*)?oz\b', 1) AS oz, regexp_extract(low, '\b(\d+(?:\.\d+)?)\s*(?:grams?|g)\b', 1) AS gr,
  CASE WHEN low LIKE '%semiquincentennial $2.50%' THEN 'Semiquincentennial $2.50' WHEN low LIKE '%canadian gold maple leaf%' THEN 'Canadian Gold Maple Leaf' WHEN low LIKE '%mexican gold libertad%' THEN 'Mexican Gold Libertad' WHEN low LIKE '%british lunar%' THEN 'British Lunar' WHEN low LIKE '%perth lunar%' THEN 'Perth Lunar'
    WHEN low LIKE '%year of the ox%' THEN concat_ws(' ', CASE WHEN regexp_matches(low, '\bsilver\b') THEN 'Silver' WHEN regexp_matches(low, '\bgold\b') THEN 'Gold' END, 'Year Of The Ox') WHEN low LIKE '%panda%' THEN 'Panda'
    WHEN low LIKE '%wedge-tailed eagle%' THEN 'Wedge-Tailed Eagle' WHEN low LIKE '%gold buffalo%' THEN 'Gold Buffalo' WHEN low LIKE '%american silver eagle%' THEN 'American Silver Eagle' WHEN low LIKE '%palladium eagle%' THEN 'Palladium Eagle' WHEN low LIKE '%st. gaudens double eagle%' THEN 'St. Gaudens Double Eagle'
    WHEN low LIKE '%walking liberty half%' THEN 'Walking Liberty Half' WHEN low LIKE '%seated liberty dime%' THEN 'Seated Liberty Dime' WHEN low LIKE '%morgan%' THEN 'Morgan' WHEN low LIKE '%buffalo nickel%' THEN 'Buffalo Nickel'
    WHEN low LIKE '%ike%' THEN 'Ike' WHEN low LIKE '%ase%' THEN 'Ase' WHEN low LIKE '%half dollar%' THEN 'Half Dollar' WHEN low LIKE '%quarter%' THEN 'Quarter' WHEN low LIKE '%dollar%' THEN 'Dollar' END AS name FROM h),
parsed AS (SELECT p_partkey, title, exclusions, nullif(regexp_extract(low, '\b(1[7-9]\d\d|20[0-2]\d)\b', 1), '')::INT AS year,
  coalesce(nullif(upper(regexp_extract(low, '\b\d{{4}}\s*-?\s*(cc|[sdpwo])\b', 1)), ''), CASE WHEN regexp_matches(low, '(^|[\s-])cc\b') THEN 'CC' END,
    nullif(upper(regexp_extract(low, '\b(cent|dollar|dime|quarter|half|nickel|penny|eagle)\s+([sdpwo])\b', 2)), ''), CASE WHEN low LIKE '%mint mark: o%' THEN 'O' WHEN low LIKE '%s mint' THEN 'S' END) AS mint,
  CASE WHEN struck THEN 'Proof' ELSE g0 END AS grade, CASE WHEN NOT struck THEN regexp_extract(g0, '\d+')::INT END AS grade_number, CASE WHEN NOT struck AND g0 IS NOT NULL THEN s0 END AS grade_source,
  CASE WHEN low LIKE '% dcam%' THEN 'DCAM' WHEN low LIKE '%proof-like pl%' THEN 'PL' END AS designation, CASE WHEN struck THEN 'Proof' ELSE f0 END AS finish, regexp_matches(low, '\broll\b') AS is_roll, set_type, CASE WHEN low LIKE '%type 2%' THEN 'Type 2' END AS label,
  CASE WHEN oz LIKE '%/%' THEN split_part(oz, '/', 1)::DOUBLE / split_part(oz, '/', 2)::DOUBLE WHEN oz NOT IN ('', '0') THEN oz::DOUBLE WHEN regexp_matches(low, '\bquarter ounce\b') THEN 0.25 WHEN low LIKE '% .5g%' THEN 0.5 / 31.1035 WHEN gr <> '' THEN gr::DOUBLE / 31.1035 WHEN low LIKE '%half gram%' THEN 0.5 / 31.1035 END AS weight,
  CASE WHEN regexp_matches(low, '\bgold\b') THEN 'gold' WHEN regexp_matches(low, '\bsilver\b') THEN 'silver' WHEN regexp_matches(low, '\bplatinum\b') THEN 'platinum' WHEN regexp_matches(low, '\bpalladium\b') THEN 'palladium' WHEN regexp_matches(low, '\bcopper\b') THEN 'copper' END AS metal,
  coalesce(name, CASE set_type WHEN 'prestige' THEN 'US Prestige Proof Set' WHEN 'silver' THEN 'US Silver Proof Set' WHEN 'clad' THEN 'US Proof Set' WHEN 'mint-uncirculated' THEN 'US Mint Set' END) AS series FROM k)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title.parsed(table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("title")), "title").drop("plain", "bar_maker", "bar_line")


@query(f"WITH {_PARSED} SELECT * FROM parsed")
def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the titles of all parts say."""
    return _titles(spark, sf_dir)


@query(rf"""WITH {_PARSED}, w AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 2 WHEN 2 THEN 1.5 END AS asked, CASE p_partkey % 9 WHEN 0 THEN 'First Strike' WHEN 1 THEN '' END AS slab,
  replace(replace(replace(replace(series, 'Mexican', 'Mexico'), 'Canadian', 'Canada'), 'British', 'Great Britain'), 'Chinese', 'China') AS s FROM parsed),
j AS (SELECT *, concat_ws(' ', CASE WHEN year IS NULL THEN mint ELSE concat_ws('-', year, mint) END, s, finish, CASE WHEN grade <> 'Proof' THEN grade WHEN grade = 'Proof' AND finish IS NULL THEN 'Proof' END, designation,
  CASE asked WHEN 0.25 THEN '1/4 oz' WHEN 2 THEN '2 oz' WHEN 1.5 THEN '1.5 oz' END, nullif(slab, '')) AS base FROM w),
n AS (SELECT *, regexp_matches(lower(base), '\bgold\b') AS au, regexp_matches(lower(base), '\bsilver\b') AS ag, regexp_matches(lower(base), '\b(platinum|palladium)\b') AS pt FROM j)
SELECT p_partkey, CASE WHEN s IS NOT NULL AND (base <> s OR (pt AND NOT (au AND ag)) OR au <> ag) THEN base || CASE WHEN NOT ag AND (pt OR au) THEN ' -silver' ELSE '' END || CASE WHEN NOT au AND (pt OR ag) THEN ' -gold' ELSE '' END ELSE title END AS keywords FROM n""")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search that each parsed title stands for, with a weight and a label as asked."""
    rows = _titles(spark, sf_dir)
    k = F.col("p_partkey")
    weight = F.when(k % 5 == 0, 0.25).when(k % 5 == 1, 2.0).when(k % 5 == 2, 1.5)
    label = F.when(k % 9 == 0, "First Strike").when(k % 9 == 1, "")
    named = {c: F.col(c) for c in ("year", "mint", "series", "finish", "grade", "designation")}
    return rows.select("p_partkey", title.keywords(named, F.col("title"), weight, label).alias("keywords"))


_ITEM = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN upper(p_name) || ' dollar' WHEN 3 THEN p_type ELSE ' The ' || p_name END"
_MARK = "CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'd' END"
_DATES = """SELECT min(p_partkey) AS nth, p_name AS series, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE p_size END AS year, CASE WHEN count(*) % 2 = 0 OR count(*) % 3 = 0 THEN '*' ELSE 'd' END AS mint, 'tier ' || CAST(min(p_partkey) % 4 AS STRING) AS tier FROM part GROUP BY p_name, p_size"""


@query(f"""WITH d AS ({_DATES.replace("STRING", "VARCHAR")}), i AS (SELECT p_partkey, trim(lower({_ITEM})) AS s, p_size AS y, lower(coalesce({_MARK}, '')) AS m FROM part),
h AS (SELECT p_partkey, tier, nth, CASE WHEN s = series AND y = year AND m = mint THEN 0 WHEN s = series AND y = year AND mint = '*' THEN 1 WHEN s = series AND year = 0 AND mint = '*' THEN 2 ELSE 3 END AS step FROM i, d
  WHERE (s = series AND (y = year AND mint IN (m, '*') OR year = 0 AND mint = '*')) OR ((year = 0 OR year = y) AND mint IN (m, '*') AND (contains(s, series) OR contains(series, s))))
SELECT i.p_partkey, h.tier, h.step FROM i LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY step, nth) = 1) h ON h.p_partkey = i.p_partkey""")
def key_date_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key dates by their own name, any mint, any year, or a likeness of names."""
    part = table(spark, sf_dir, "part")
    dates = part.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("nth"), F.count(F.lit(1)).alias("n"))
    dates = dates.selectExpr("nth", "p_name AS series", "CASE WHEN n % 3 = 0 THEN 0 ELSE p_size END AS year", "CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN '*' ELSE 'd' END AS mint", "'tier ' || nth % 4 AS tier")
    items = part.selectExpr("p_partkey", f"{_ITEM} AS series", "p_size AS year", f"{_MARK} AS mint")
    return ladders.key_dates(items, dates).select("p_partkey", "tier", "step")


_OUNCE = "CASE p_partkey % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 END"
_STRUCK = "CASE p_partkey % 4 WHEN 0 THEN 'Reverse Proof' WHEN 1 THEN 'Burnished' END"
_WANTED = "CASE p_partkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 's' WHEN 2 THEN '' END"


@query(f"""WITH s AS (SELECT lower(p_type) || CASE p_partkey % 6 WHEN 0 THEN ' proof' WHEN 1 THEN ' 1/2 oz' WHEN 2 THEN ' 2 oz' ELSE '' END AS series, p_size AS year, CASE length(p_name) % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'D' WHEN 2 THEN 'S' ELSE 'W' END AS mint, p_partkey, p_retailprice FROM part),
d AS (SELECT series, year, mint, CAST(floor(max(p_retailprice)) AS BIGINT) AS mintage, min(p_partkey) AS nth FROM s GROUP BY ALL),
f AS (SELECT series, year, arg_min(mintage, nth) AS mintage FROM d GROUP BY ALL),
i AS (SELECT p_partkey, lower(p_type) AS s, p_size AS year, coalesce(nullif(upper({_WANTED}), ''), 'P') AS m, coalesce({_STRUCK} LIKE '%Proof%', false) AS p, CASE {_OUNCE} WHEN 0.5 THEN ' 1/2 oz' WHEN 0.1 THEN ' 1/10 oz' WHEN 2.0 THEN ' 2 oz' END AS z FROM part)
SELECT p_partkey, CASE WHEN p THEN coalesce(a.mintage, b.mintage) ELSE coalesce(c.mintage, e.mintage) END AS mintage, CASE WHEN p AND coalesce(a.mintage, b.mintage) IS NOT NULL THEN s || ' proof' WHEN NOT p AND c.mintage IS NOT NULL THEN s || z WHEN NOT p AND e.mintage IS NOT NULL THEN s END AS found_in
FROM i LEFT JOIN d a ON a.series = s || ' proof' AND a.year = i.year AND a.mint = m LEFT JOIN f b ON b.series = s || ' proof' AND b.year = i.year LEFT JOIN d c ON c.series = s || z AND c.year = i.year AND c.mint = m LEFT JOIN d e ON e.series = s AND e.year = i.year AND e.mint = m""")
def mintage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many were struck: proofs among proofs only, fractions before the series' own table."""
    part = table(spark, sf_dir, "part")
    series = F.expr("lower(p_type) || CASE p_partkey % 6 WHEN 0 THEN ' proof' WHEN 1 THEN ' 1/2 oz' WHEN 2 THEN ' 2 oz' ELSE '' END")
    mint = F.expr("CASE length(p_name) % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'D' WHEN 2 THEN 'S' ELSE 'W' END")
    mints = part.groupBy(series.alias("series"), F.col("p_size").alias("year"), mint.alias("mint")).agg(F.floor(F.max("p_retailprice")).alias("mintage"), F.min("p_partkey").alias("nth"))
    items = part.selectExpr("p_partkey", "p_type AS series", "p_size AS year", f"{_WANTED} AS mint", f"CAST({_OUNCE} AS DOUBLE) AS weight", f"{_STRUCK} AS finish")
    return ladders.mintages(items, mints).select("p_partkey", "mintage", "found_in")


@query("""WITH n AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'a' WHEN p_size % 3 = 1 THEN 'b' ELSE 'c' END AS listed_in, 1900 + p_size AS year, CASE p_partkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'D' END AS mint, min(p_partkey) AS number FROM part GROUP BY ALL),
i AS (SELECT p_partkey, lower(p_name) AS s, 1895 + p_partkey % 60 AS year, CASE p_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'O' WHEN 2 THEN '' END AS m FROM part),
t AS (SELECT p_partkey, unnest([{'o': 0, 't': CASE WHEN s LIKE '%ring%' THEN 'b' END}, {'o': 1, 't': CASE WHEN s LIKE '%ring%' THEN 'a' END}, {'o': 2, 't': CASE WHEN regexp_matches(s, '^(red|blue|hot) ') THEN 'c' END}, {'o': 3, 't': CASE WHEN s LIKE '%g%' THEN 'a' END}, {'o': 4, 't': CASE WHEN s LIKE '%g%' THEN 'b' END}]) AS u FROM i),
h AS (SELECT i.p_partkey, n.number, n.listed_in, t.u.o AS o, CASE WHEN n.mint = coalesce(nullif(i.m, ''), 'P') THEN 0 WHEN n.mint = 'P' THEN 1 ELSE 2 END AS r FROM i JOIN t ON t.p_partkey = i.p_partkey JOIN n ON n.listed_in = t.u.t AND n.year = i.year)
SELECT i.p_partkey, h.number, h.listed_in FROM i LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o, r, number) = 1) h ON h.p_partkey = i.p_partkey""")
def catalogue_number_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue numbers: the first table, by the series' rules, that has the year; its mint, Philadelphia or the first."""
    part = table(spark, sf_dir, "part")
    kind = F.expr("CASE WHEN p_size % 3 = 0 THEN 'a' WHEN p_size % 3 = 1 THEN 'b' ELSE 'c' END")
    mint = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'D' END")
    numbers = part.groupBy(kind.alias("listed_in"), (F.col("p_size") + 1900).alias("year"), mint.alias("mint")).agg(F.min("p_partkey").alias("number")).withColumn("nth", F.col("number"))
    items = part.selectExpr("p_partkey", "p_name AS series", "1895 + p_partkey % 60 AS year", "CASE p_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'O' WHEN 2 THEN '' END AS mint")
    rules = [("ring", ["b", "a"]), ("^(red|blue|hot) ", ["c"]), ("g", ["a", "b"])]
    return ladders.first_table(items, rules, numbers).select("p_partkey", "number", "listed_in")


_MINTED = "CASE WHEN o_orderkey % 41 <> 0 THEN 1780 + o_orderkey % 330 END"


@query(f"""WITH o AS (SELECT o_orderkey, {_MINTED} AS y FROM orders),
d AS (SELECT *, CASE WHEN y < 1794 OR y > 2100 OR y IS NULL THEN 'Unknown' WHEN y >= 1964 THEN 'Kennedy' WHEN y >= 1948 THEN 'Franklin' WHEN y >= 1916 THEN 'Walking Liberty' WHEN y >= 1892 THEN 'Barber' WHEN y >= 1839 THEN 'Seated Liberty' WHEN y >= 1807 THEN 'Capped Bust' WHEN y >= 1796 THEN 'Draped Bust' ELSE 'Flowing Hair' END AS design FROM o)
SELECT o_orderkey, design, CASE WHEN design = 'Unknown' THEN 'Unknown' WHEN y < 1839 THEN '89.24% Silver' WHEN y < 1965 THEN '90% Silver' WHEN y < 1971 THEN '40% Silver' ELSE 'Copper-Nickel Clad' END AS composition, CASE y WHEN 1976 THEN 'Bicentennial' WHEN 2026 THEN 'Semiquincentennial' END AS suffix,
'Half Dollar — ' || design || CASE y WHEN 1976 THEN ' (Bicentennial)' WHEN 2026 THEN ' (Semiquincentennial)' ELSE '' END AS label FROM d""")
def half_dollar_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design, metal and label of the half dollar of each year."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_MINTED).cast("int").alias("year"))
    return intervals.half_dollars(rows, "year").drop("year")


_RULES = "s_nationkey AS nation, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 50 - 10 END AS low, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 50 + s_suppkey % 23 - 8 END AS high, s_suppkey % 3 AS priority, s_name AS rule"


@query(f"""WITH r AS (SELECT {_RULES} FROM supplier), c AS (SELECT c_custkey, c_nationkey AS nation, CAST(floor(c_acctbal / 200) AS BIGINT) AS v FROM customer),
h AS (SELECT c_custkey, rule FROM c JOIN r ON r.nation = c.nation AND (low IS NULL OR low <= v) AND (high IS NULL OR v <= high) AND NOT coalesce(low > high, false)
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority, coalesce(high - low, 9223372036854775807), greatest(coalesce(low, -1e9), (SELECT min(v) FROM c)) DESC, rule) = 1)
SELECT c.c_custkey, h.rule FROM c LEFT JOIN h ON h.c_custkey = c.c_custkey""")
def interval_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each customer's nation that holds at their balance; rules overlap and may be open."""
    rules = table(spark, sf_dir, "supplier").selectExpr(*_RULES.split(", "))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 200).alias("at"))
    return intervals.interval_join(rows, rules, ["nation"], "at", ["rule"]).select("c_custkey", "rule")


#: A bar for each part: makers, lines and other words by numbers without a common factor.
_BAR = """concat_ws(' ', CASE p_partkey % 7 WHEN 0 THEN '1 oz' WHEN 1 THEN '100g' END, CASE p_partkey % 11 WHEN 0 THEN 'PAMP Suisse' WHEN 1 THEN 'pamp' WHEN 2 THEN 'Geiger  Edelmetalle' WHEN 3 THEN 'Perth Mint' WHEN 4 THEN 'Perth mint PAMP' WHEN 5 THEN 'credit suisse' WHEN 6 THEN 'Scottsdale' ELSE p_name END,
CASE p_partkey % 13 WHEN 0 THEN 'Lady Fortuna' WHEN 1 THEN 'cast' WHEN 2 THEN 'dragon ball' WHEN 3 THEN 'Dragon' WHEN 4 THEN 'statue of liberty' WHEN 5 THEN 'bull' WHEN 6 THEN 'square' WHEN 7 THEN 'poured' WHEN 8 THEN 'castle lion' WHEN 9 THEN 'hearts' END, CASE p_partkey % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'bars' ELSE 'barrel' END)"""
_MAKER = "CASE p_partkey % 5 WHEN 0 THEN 'PAMP' WHEN 1 THEN ' perth  MINT' WHEN 2 THEN 'Geiger' WHEN 3 THEN 'pamp suisse' END"
_LINE = "CASE p_partkey % 4 WHEN 0 THEN 'fortuna' WHEN 1 THEN 'dragon bar' WHEN 2 THEN 'castle' END"


@query(rf"""WITH t AS (SELECT p_partkey, lower({_BAR}) AS low, CASE p_partkey % 5 WHEN 0 THEN 'PAMP' WHEN 1 THEN 'Perth Mint' WHEN 2 THEN 'Geiger' WHEN 3 THEN 'PAMP' END AS own, p_partkey % 4 AS h FROM part),
m AS (SELECT *, list_filter([CASE WHEN low LIKE '%pamp%' THEN 'PAMP' END, CASE WHEN low LIKE '%geiger%' THEN 'Geiger' END, CASE WHEN low LIKE '%perth mint%' THEN 'Perth Mint' END, CASE WHEN low LIKE '%scottsdale%' THEN 'Scottsdale' END, CASE WHEN low LIKE '%credit suisse%' THEN 'Credit Suisse' END], lambda x: x IS NOT NULL) AS found,
  CASE WHEN own = 'PAMP' AND h = 0 THEN 'Fortuna' WHEN own = 'Perth Mint' AND h = 1 THEN 'Dragon' WHEN own = 'Geiger' AND h = 2 THEN 'Schloss Guldengossa' END AS line FROM t),
l AS (SELECT *, CASE WHEN own = 'PAMP' THEN CASE WHEN low LIKE '%fortuna%' THEN 'Fortuna' WHEN low LIKE '%liberty%' THEN 'Lady of Liberty' END WHEN own = 'Geiger' THEN CASE WHEN low LIKE '%square%' THEN 'Square' WHEN low LIKE '%hearts%' THEN 'Love' WHEN low LIKE '%edelmetalle%' THEN 'Edelmetalle' END
  WHEN own = 'Perth Mint' THEN CASE WHEN regexp_matches(low, '\bcast\b') THEN 'Cast' WHEN low LIKE '%dragon%' AND low NOT LIKE '%dragon ball%' THEN 'Dragon' END END AS here,
  CASE WHEN regexp_matches(low, '\bbars?\b') THEN found[1] END AS bar_maker FROM m)
SELECT p_partkey, found AS makers, own AS wanted, line, bar_maker,
CASE bar_maker WHEN 'PAMP' THEN CASE WHEN low LIKE '%fortuna%' THEN 'Fortuna' WHEN low LIKE '%liberty%' THEN 'Lady of Liberty' WHEN regexp_matches(low, '\bbull\b') THEN 'Zodiac - Taurus' WHEN low LIKE '%lion%' THEN 'Zodiac - Leo' END WHEN 'Geiger' THEN CASE WHEN low LIKE '%square%' THEN 'Square' WHEN low LIKE '%castle%' THEN 'Schloss Guldengossa' WHEN low LIKE '%hearts%' THEN 'Love' ELSE 'Edelmetalle' END
  WHEN 'Perth Mint' THEN CASE WHEN regexp_matches(low, '\b(cast|poured)\b') THEN 'Cast' WHEN low LIKE '%dragon%' AND low NOT LIKE '%dragon ball%' THEN 'Dragon' END WHEN 'Scottsdale' THEN CASE WHEN regexp_matches(low, '\b(cast|poured)\b') THEN 'Cast' END WHEN 'Credit Suisse' THEN CASE WHEN low LIKE '%liberty%' THEN 'Statue of Liberty' END END AS bar_line,
CASE WHEN line IS NULL THEN NULL WHEN len(list_filter(found, lambda x: x <> own)) > 0 THEN 'barBrandMismatch' WHEN here <> line THEN 'barSeriesMismatch' END AS removed_by FROM l""")
def bar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers and lines that titles of bars name, and the rule by which they are not the bar that is wanted."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BAR).alias("title"), F.expr(_MAKER).alias("own"), F.expr(_LINE).alias("hint"))
    rows = rows.withColumn("wanted", bars.canonical_maker(F.col("own"))).withColumn("line", bars.line_by_hint(F.col("wanted"), F.col("hint")))
    found = title.parsed(rows, "title")
    columns = [bars.makers(F.col("title")).alias("makers"), "wanted", "line", "bar_maker", "bar_line", bars.mismatch(F.col("title"), F.col("wanted"), F.col("line")).alias("removed_by")]
    return found.select("p_partkey", *columns)


#: A listing and what is wanted, for each part.
_SOLD = """concat_ws(' ', CASE p_partkey % 7 WHEN 0 THEN '1881-CC' WHEN 1 THEN '1900 O/S' WHEN 2 THEN '1921 D' WHEN 3 THEN 'Denver 1964' WHEN 4 THEN '1893 S and 1893 D' WHEN 5 THEN 'CC hoard' END,
CASE p_partkey % 11 WHEN 0 THEN 'Morgan dollar' WHEN 1 THEN 'Washington quarter' WHEN 2 THEN 'half dollar' WHEN 3 THEN 'silver 1 oz gold gilded' WHEN 4 THEN '1 oz gold and silver coin' WHEN 5 THEN 'gold black ruthenium silver' WHEN 6 THEN 'gold silver 10 yuan' WHEN 7 THEN 'gold coin' WHEN 8 THEN 'Mercury dime' ELSE p_name END,
CASE p_partkey % 13 WHEN 0 THEN 'MS65' WHEN 1 THEN 'PCGS MS-64' WHEN 2 THEN 'ngc PF 70 and MS65' WHEN 3 THEN 'Type 1' WHEN 4 THEN 'type  2 proof' WHEN 5 THEN 'roll' WHEN 6 THEN 'tube of' WHEN 7 THEN 'mint set' WHEN 8 THEN 'Proof' WHEN 9 THEN 'AU58' END)"""
_WISHED = {"mint": "CASE p_partkey % 5 WHEN 0 THEN 'cc' WHEN 1 THEN 'S' WHEN 2 THEN 'D' ELSE 'O' END", "denomination": "CASE p_partkey % 3 WHEN 0 THEN 'quarter' WHEN 1 THEN 'dollar' END", "grade": "CASE p_partkey % 4 WHEN 0 THEN 'MS65' WHEN 1 THEN 'PR70' WHEN 2 THEN 'Proof' END", "label": "CASE p_partkey % 2 WHEN 0 THEN 'Type 1' ELSE 'Type 2' END", "metal": "CASE p_partkey % 17 WHEN 0 THEN 'gold' WHEN 1 THEN NULL ELSE 'silver' END"}
_RULES_SHOWN = ["notSet", "notRoll", "notProof", "excluded", "metalMismatch", "typeMismatch", "mintMismatch", "denomMismatch", "gradeNumMismatch", "pcgsOnly", "gradeOnly"]


@query(rf"""WITH t AS (SELECT p_partkey AS k, {_SOLD} AS title, {", ".join(f"{v} AS {n}" for n, v in _WISHED.items())} FROM part), l AS (SELECT *, lower(title) AS low FROM t),
m AS (SELECT *, regexp_matches(low, '\bgold\b') AS au, regexp_matches(low, '\bsilver\b') AS ag, CASE k % 7 WHEN 0 THEN ['CC'] WHEN 1 THEN ['O', 'S'] WHEN 2 THEN ['D'] WHEN 3 THEN ['D'] WHEN 4 THEN ['S', 'D'] WHEN 5 THEN ['CC'] END AS mints, CASE k % 13 WHEN 0 THEN [65] WHEN 1 THEN [64] WHEN 2 THEN [70, 65] WHEN 9 THEN [58] END AS nums,
  CASE grade WHEN 'MS65' THEN 65 WHEN 'PR70' THEN 70 END AS want, CASE k % 11 WHEN 0 THEN 'dollar' WHEN 1 THEN 'quarter' WHEN 2 THEN 'half dollar' WHEN 8 THEN 'dime' END AS denom FROM l),
e AS (SELECT *, CASE WHEN k % 11 = 3 THEN 'silver' WHEN k % 11 = 4 THEN 'gold' WHEN k % 11 = 5 THEN 'silver' WHEN au THEN 'gold' WHEN ag THEN 'silver' END AS made FROM m)
SELECT k AS p_partkey, NOT regexp_matches(low, '\bset\b') AS "notSet", k % 13 NOT IN (5, 6) AS "notRoll", NOT regexp_matches(low, '\bproof\b') AS "notProof", low LIKE '%ms%' OR low LIKE '%gold%' AS excluded,
CASE WHEN metal IS NOT NULL AND made IS NOT NULL THEN made <> metal OR metal = 'gold' AND (low LIKE '%silver coin%' OR low LIKE '%yuan%silver%') OR metal = 'silver' AND (low LIKE '%gold coin%') ELSE false END AS "metalMismatch",
CASE label WHEN 'Type 1' THEN k % 13 = 4 ELSE k % 13 = 3 END AS "typeMismatch", coalesce(NOT list_contains(mints, upper(mint)), false) AS "mintMismatch", coalesce(denom <> denomination, false) AS "denomMismatch", CASE WHEN nums IS NULL OR want IS NULL THEN false ELSE NOT list_contains(nums, want) END AS "gradeNumMismatch",
k % 13 <> 1 AS "pcgsOnly", CASE grade WHEN 'MS65' THEN k % 13 NOT IN (0, 2) WHEN 'PR70' THEN true WHEN 'Proof' THEN NOT regexp_matches(low, '\bproof\b') ELSE false END AS "gradeOnly" FROM e""")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of the chain by itself, over all listings: which ones would remove them."""
    from ..operators import audit

    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SOLD).alias("title"), *[F.expr(v).alias(n) for n, v in _WISHED.items()])
    yes = F.lit(True)
    wanted = {n: F.col(n) for n in _WISHED} | {"set": yes, "roll": yes, "proof": yes, "pcgs_only": yes, "grade_only": yes, "exclusions": F.array(F.lit("ms"), F.lit("gold"))}
    rules = dict(audit.listing_rules(F.col("title"), wanted))
    return t.select("p_partkey", *[F.coalesce(rules[n], F.lit(False)).alias(n) for n in _RULES_SHOWN])


_SCORED = """concat_ws(' ', CASE p_partkey % 5 WHEN 0 THEN '1881-CC' WHEN 1 THEN '1900 S' WHEN 2 THEN 'Denver' WHEN 4 THEN '1921' END, CASE p_partkey % 7 WHEN 0 THEN 'MS65' WHEN 1 THEN 'PCGS MS63' WHEN 2 THEN 'NGC PF70 proof' WHEN 3 THEN 'BU' WHEN 4 THEN 'proof' END,
CASE p_partkey % 4 WHEN 0 THEN 'roll' WHEN 1 THEN 'proof set' WHEN 2 THEN 'mint set' END, CASE WHEN p_partkey % 3 = 0 THEN 'DCAM' END, CASE p_partkey % 11 WHEN 0 THEN 'lunar dragon' WHEN 1 THEN 'Dragon' WHEN 2 THEN '1 oz' WHEN 3 THEN '1/2 oz' WHEN 4 THEN 'quarter' END)"""


@query("""WITH t AS (SELECT p_partkey AS k, p_retailprice AS price, p_partkey % 7 IN (2, 4) OR p_partkey % 4 = 1 AS proof, p_partkey % 10 < 4 OR p_partkey % 6 = 1 AS wants, p_partkey % 8 < 2 AS want_set, p_partkey % 4 IN (1, 2) AS has_set, p_partkey % 6 AS g, p_partkey % 7 AS b, p_partkey % 11 AS e FROM part),
p AS (SELECT *, CASE WHEN proof THEN 'proof' WHEN b < 3 THEN 'graded' ELSE 'raw' END AS pool FROM t)
SELECT k AS p_partkey, least(100, 50 + CASE WHEN b = 1 THEN 5 ELSE 0 END
+ CASE g WHEN 0 THEN CASE b WHEN 0 THEN 15 WHEN 1 THEN 5 - 30 WHEN 2 THEN 5 - 40 ELSE 0 END WHEN 1 THEN CASE b WHEN 1 THEN 5 - 40 WHEN 2 THEN 5 ELSE 0 END WHEN 2 THEN CASE b WHEN 3 THEN 15 + 10 WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 0 END ELSE 0 END
+ CASE WHEN wants AND NOT proof OR NOT wants AND proof AND NOT want_set THEN -25 ELSE 0 END + CASE WHEN g < 3 THEN CASE WHEN pool <> 'graded' THEN -20 ELSE 0 END WHEN pool <> 'raw' THEN -25 ELSE 0 END + CASE WHEN proof AND NOT wants THEN -20 ELSE 0 END
+ CASE WHEN k % 9 < 3 THEN CASE WHEN k % 4 = 0 THEN 15 ELSE -30 END ELSE 0 END + CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 10 ELSE -30 END WHEN 1 THEN CASE WHEN k % 2 = 1 THEN 10 ELSE -30 END WHEN 2 THEN -30 ELSE 0 END + CASE WHEN wants THEN CASE WHEN k % 3 = 0 THEN 10 ELSE -15 END ELSE 0 END
+ CASE WHEN want_set THEN CASE WHEN has_set THEN 15 WHEN e = 4 THEN -60 ELSE -35 END + CASE WHEN k % 16 < 8 AND proof AND k % 4 <> 2 OR k % 16 >= 8 AND k % 4 = 2 AND NOT proof THEN -20 ELSE 0 END ELSE 0 END
+ CASE WHEN e < 2 THEN 5 ELSE 0 END + CASE WHEN e = 0 THEN 3 ELSE 0 END + CASE e WHEN 2 THEN -35 WHEN 3 THEN 25 ELSE -15 END + CASE WHEN e NOT IN (2, 3) AND price > 400 * 0.5 * 5 THEN -20 ELSE 0 END) AS score FROM p""")
def score_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that rest on grade, slab, mint, roll, set, designation, animal, weight and spot price."""
    from ..operators import score

    k = F.col("p_partkey")
    wanted = {
        "grade": F.when(k % 6 == 0, "MS65").when(k % 6 == 1, "PR70").when(k % 6 == 2, "BU"), "mint": F.when(k % 2 == 0, "cc").otherwise("S"), "roll": k % 9 < 3, "set": k % 8 < 2, "set_type": F.when(k % 16 < 8, "mint-uncirculated").otherwise("silver-proof"),
        "proof": k % 10 < 4, "designation": F.lit("DCAM"), "animal": F.lit("Dragon"), "lunar": F.lit(True), "weight": F.lit(0.5), "price": F.col("p_retailprice"), "spot": F.lit(400.0),
    }
    t = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.expr(_SCORED).alias("title"))
    return t.select("p_partkey", score.coin(F.col("title"), wanted).alias("score"))
