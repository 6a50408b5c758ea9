"""Text, rule and token queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import rarity
from ..operators import audit, holdings, resolve, variants
from ..operators.lookup import first_rule_join, token_matches
from ..registry import query, table
from .common import SALES, sales

#: A made-up listing title from a part: metal, weight, year and grade by its numbers.
_METALS = "CASE p_partkey % 5 WHEN 0 THEN 'Silver' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Platinum' WHEN 3 THEN 'Silver' ELSE '' END"
_TITLE = f"""concat_ws(' ', 1900 + p_partkey % 120, p_name, p_type, {_METALS}, CASE p_partkey % 4 WHEN 0 THEN '1 oz' WHEN 1 THEN '1/2 oz' WHEN 2 THEN '31.1 g' ELSE '' END,
CASE p_partkey % 6 WHEN 0 THEN 'MS-65' WHEN 1 THEN 'PF69' WHEN 2 THEN 'Reverse Proof' WHEN 3 THEN 'U.S. roll' ELSE 'half dollar -copy' END)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", F.expr(_TITLE).alias("title"))


TITLES = _T = f"t AS (SELECT p_partkey, p_size, p_retailprice, p_brand, {_TITLE} AS title FROM part)"


def _steps(x: str) -> str:
    for pattern, to in text.KEY_STEPS:
        to = to.replace("$", "\\")
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_KEY = f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({_steps('lower(title)')}, '\\s+'), lambda w: w <> ''))), ' ')"


@query(f"WITH {_T} SELECT p_partkey, {_KEY} AS key FROM t")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("p_partkey", text.search_key(F.col("title")).alias("key"))


def _grade(x: str) -> str:
    return f"nullif(regexp_replace(upper(regexp_extract(lower({x}), '{text.GRADE}', 1)) || regexp_extract(lower({x}), '{text.GRADE}', 2), '^PF', 'PR'), '')"


@query(f"WITH {_T} SELECT p_partkey, TRY_CAST(nullif(regexp_extract(title, '{text.YEAR}', 1), '') AS INT) AS year, {_grade('title')} AS grade, list_transform(regexp_extract_all(lower(title), '(?:^|\\s)-([a-z]+)', 1), lambda x: x) AS excluded FROM t")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, grade and excluded words of each title."""
    t = F.col("title")
    return titles(spark, sf_dir).select("p_partkey", text.year(t).alias("year"), text.grade(t).alias("grade"), text.exclusions(t).alias("excluded"))


_DENY = "\\b(" + "|".join(text.DENIED) + ")\\b"
_DENOM = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{n}'" for n, p in text.DENOMINATIONS) + " END"


@query(f"""SELECT doc_id, regexp_matches(lower(text), '{_DENY}') OR regexp_matches(regexp_replace(lower(text), '\\bstamps?\\s*(die|error|double|over|variet)', '', 'g'), '\\bstamps?\\b') OR regexp_matches(lower(text), '{text.ROLLS}') AS denied FROM documents""")
def deny_list_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.denied(F.col("text")).alias("denied"))


@query(f"""WITH {_T} SELECT p_partkey, {_DENOM.format("title")} AS denomination,
CASE WHEN regexp_matches(lower(title), '\\breverse\\s*proof\\b') THEN 'reverse-proof' WHEN regexp_matches(regexp_replace(lower(title), 'proof[- ]?like', '', 'g'), '\\bproof\\b') THEN 'proof'
WHEN regexp_matches(lower(title), '\\b(pcgs|ngc|anacs|icg)\\b') OR {_grade("title")} IS NOT NULL THEN 'graded' ELSE 'raw' END AS pool FROM t""")
def ordered_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return titles(spark, sf_dir).select("p_partkey", text.denomination(t).alias("denomination"), text.pool(t).alias("pool"))


_METAL = f"""CASE WHEN {" + ".join(f"CAST(regexp_matches(lower(title), '\\b{x}\\b') AS INT)" for x in text.METALS)} > 1 THEN CASE WHEN regexp_matches(lower(title), '\\b(22|24)k\\b|[.]9167') THEN 'gold' WHEN regexp_matches(lower(title), '[.]925|\\b90%') THEN 'silver' WHEN regexp_matches(lower(title), '\\bgold\\s+(plated|gilded)\\b') THEN 'silver' END
{" ".join(f"WHEN regexp_matches(lower(title), '\\b{x}\\b') THEN '{x}'" for x in text.METALS)} WHEN regexp_matches(lower(title), '\\b(22|24)k\\b|[.]9167') THEN 'gold' WHEN regexp_matches(lower(title), '[.]925|\\b90%') THEN 'silver' END"""
_WEIGHT = """CASE WHEN title LIKE '%1/2 oz%' THEN 0.5::DOUBLE WHEN title LIKE '%1 oz%' THEN 1.0::DOUBLE WHEN title LIKE '%31.1 g%' THEN 31.1::DOUBLE / 31.1035::DOUBLE END"""


@query(f"WITH {_T} SELECT p_partkey, {_METAL} AS metal, {_WEIGHT} AS weight FROM t")
def metal_and_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return titles(spark, sf_dir).select("p_partkey", text.metal(t).alias("metal"), text.weight(t).alias("weight"))


@query("SELECT c_custkey, sha256(concat_ws('|', lower(trim(c_name)), c_nationkey::VARCHAR, lower(c_mktsegment), '', '', '')) AS hash FROM customer")
def item_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of six normalised fields."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", holdings.item_hash(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"), none, none, none).alias("hash"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, nullif(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') AS title, length(regexp_replace(html, '(?s)<[^>]*>', '', 'g'))::BIGINT AS text_length FROM pages")
def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    title = F.nullif(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return p.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), title.alias("title"), F.length(F.regexp_replace("html", "(?s)<[^>]*>", "")).cast("bigint").alias("text_length"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS incomplete FROM events")
def json_props_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), x["missing"].isNull().alias("incomplete"))


_TIERS = "CASE WHEN n < 0 OR n IS NULL THEN NULL WHEN n <= 5 THEN 'Unique' WHEN n <= 25 THEN 'Extremely Rare' WHEN n <= 100 THEN 'Very Rare' WHEN n <= 1000 THEN 'Rare' WHEN n <= 10000 THEN 'Scarce' WHEN n <= 100000 THEN 'Semi-Scarce' WHEN n <= 1000000 THEN 'Common' ELSE 'Very Common' END"


@query(f"WITH s AS (SELECT l_partkey AS part_key, CAST(sum(l_quantity) AS BIGINT) * (l_partkey % 9 - 1) * (l_partkey % 9) AS n FROM lineitem GROUP BY 1) SELECT part_key, {_TIERS} AS tier FROM s")
def rarity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part_key")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    k = F.col("part_key") % 9
    return s.select("part_key", rarity(F.col("n") * (k - 1) * k).alias("tier"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 'promo-large' WHEN p_type = 'PROMO' THEN 'promo' WHEN p_size BETWEEN 1 AND 10 THEN 'early' WHEN p_size BETWEEN 11 AND 25 THEN 'middle' WHEN p_size BETWEEN 26 AND 50 THEN 'late' END AS variant, CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 2.5::DOUBLE WHEN p_type = 'PROMO' THEN 2.0::DOUBLE WHEN p_size BETWEEN 1 AND 10 THEN 1.5::DOUBLE WHEN p_size BETWEEN 11 AND 25 THEN 1.2::DOUBLE WHEN p_size BETWEEN 26 AND 50 THEN 1.0::DOUBLE END AS factor FROM part")
def rule_table_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides first, then ranges: the first rule that holds gives all outputs."""
    size, kind = F.col("p_size"), F.col("p_type")
    rules = [((kind == "PROMO") & (size > 40), ("promo-large", 2.5)), (kind == "PROMO", ("promo", 2.0)), (size.between(1, 10), ("early", 1.5)), (size.between(11, 25), ("middle", 1.2)), (size.between(26, 50), ("late", 1.0))]
    out = first_rule_join(table(spark, sf_dir, "part"), [(c, dict(zip(("variant", "factor"), v))) for c, v in rules], ["variant", "factor"])
    return out.select("p_partkey", "variant", "factor")


_WORDS = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: length(w) > 1))"
_PAIRS = f"""q AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS query_id FROM part), k AS (SELECT DISTINCT p_brand || ' ' || p_name AS key_id FROM part),
qk AS (SELECT query_id, key_id, {_WORDS.format("query_id")} AS qw, {_WORDS.format("key_id")} AS kw FROM q, k),
h AS (SELECT query_id, key_id, len(list_intersect(qw, kw)) AS hits, len(list_intersect(qw, kw))::DOUBLE / len(kw) AS forward, len(list_intersect(qw, kw))::DOUBLE / len(qw) AS reverse FROM qk)"""


@query(f"WITH {_PAIRS} SELECT query_id, key_id, hits FROM h WHERE greatest(forward, reverse) >= 0.65 AND (forward + reverse) / 2 > 0.55")
def token_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of terms that share enough words, by an inverted index."""
    part = table(spark, sf_dir, "part")
    q = part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("query_id")).distinct()
    k = part.select(F.concat_ws(" ", "p_brand", "p_name").alias("key_id")).distinct()
    q, k = q.withColumn("words", F.split(F.lower("query_id"), " ")), k.withColumn("words", F.split(F.lower("key_id"), " "))
    return token_matches(q, k).select("query_id", "key_id", F.col("hits").cast("bigint").alias("hits"))


#: What the look-up sees in a title, and the best data set (k) of each search (q), both with title and what it says.
SAYS = f"""TRY_CAST(nullif(regexp_extract(title, '{text.YEAR}', 1), '') AS INT) AS year, {_METAL} AS metal, {_WEIGHT} AS weight, {_grade("title")} AS grade, upper(nullif(regexp_extract(lower(title), '\\b[0-9]{{4}}[-\\s]?(cc|[sdow])\\b', 1), '')) AS mark,
regexp_matches(lower(title), '{resolve.SPECIAL}') AS special, list_filter(string_split({_KEY}, ' '), lambda x: length(x) > 1) AS w"""
RESOLVED = """p AS (SELECT query_id, key_id, len(list_intersect(q.w, k.w)) / len(k.w) AS f, len(list_intersect(q.w, k.w)) / len(q.w) AS r, q.year AS qy, k.year AS ky, q.metal AS qm, k.metal AS km, q.grade AS qg, k.grade AS kg, q.mark AS qk, k.mark AS kk, abs(q.weight - k.weight) / greatest(q.weight, k.weight) AS far FROM q, k
 WHERE NOT coalesce(q.year <> k.year, false) AND NOT coalesce(q.metal <> k.metal, false) AND NOT coalesce(q.grade <> k.grade, false) AND NOT (q.grade IS NULL AND k.grade IS NOT NULL) AND NOT (k.special AND NOT q.special)),
s AS (SELECT query_id, key_id, round((f + r) / 2 + CASE WHEN qm = km THEN 0.1::DOUBLE WHEN qm IS NULL AND km IN ('gold', 'platinum', 'palladium') THEN -0.05::DOUBLE ELSE 0 END + CASE WHEN qm = km AND far <= 0.05::DOUBLE THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN qk = kk THEN 0.2::DOUBLE WHEN qk <> kk THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN qg = kg THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN qy = ky THEN 0.2::DOUBLE ELSE 0 END, 9) AS score FROM p WHERE NOT coalesce(far > 0.05::DOUBLE, false) AND greatest(f, r) >= 0.65::DOUBLE AND (f + r) / 2 > 0.55::DOUBLE),
best AS (SELECT query_id, arg_min(key_id, (-score, key_id)) AS key_id, max(score) AS score FROM s GROUP BY query_id)"""
#: A search for each part: its title without the grade.
_SEARCH = f"""concat_ws(' ', 1900 + p_partkey % 120, p_name, p_type, {_METALS}, CASE p_partkey % 4 WHEN 0 THEN '1 oz' WHEN 1 THEN '1/2 oz' WHEN 2 THEN '31.1 g' ELSE '' END, CASE p_partkey % 6 WHEN 1 THEN 'PF69' WHEN 2 THEN 'proof' END)"""


@query(f"""WITH {_T}, q0 AS (SELECT p_partkey AS query_id, {_SEARCH} AS title FROM part), q AS (SELECT query_id, {SAYS} FROM q0), k0 AS (SELECT min(p_partkey) AS key_id, title FROM t GROUP BY title), k AS (SELECT key_id, {SAYS} FROM k0), {RESOLVED}
SELECT query_id, key_id, round(score, 6) AS score FROM best""")
def token_overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best dataset for each search, with vetoes and bonuses."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_SEARCH).alias("term"))
    k = titles(spark, sf_dir).groupBy("title").agg(F.min("p_partkey").alias("key_id")).select("key_id", F.col("title").alias("term"))
    return resolve.resolve(q, k).select("query_id", "key_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_T}, r AS (SELECT p_brand, CASE WHEN p_size < 3 THEN 'lowRelevance' WHEN regexp_matches(lower(title), '{_DENY}') OR regexp_matches(lower(title), '{text.ROLLS}') THEN 'denied'
WHEN p_partkey % 17 = 0 THEN 'nonUsd' WHEN {_METAL} <> 'silver' THEN 'metalMismatch' WHEN abs({_WEIGHT} - 1.0::DOUBLE) / greatest({_WEIGHT}, 1.0::DOUBLE) >= 0.05::DOUBLE THEN 'weightMismatch'
WHEN {_WEIGHT} IS NULL AND p_retailprice > 250 * 5 THEN 'meltSanity' WHEN abs(1900 + p_partkey % 120 - 1960) > 40 THEN 'yearMismatch' WHEN p_retailprice < 100 THEN 'meltFloor' WHEN title LIKE '%Reverse Proof%' THEN 'variantMismatch' WHEN {_grade("title")} <> 'MS65' THEN 'gradeNumMismatch' ELSE 'kept' END AS rule FROM t)
SELECT p_brand, rule, count(*) AS rows FROM r GROUP BY 1, 2""")
def filter_removal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles each rule removes, in the order of the rules, by brand."""
    t = titles(spark, sf_dir)
    wanted = {"score": F.col("p_size"), "least_score": F.lit(3), "total_usd": F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")), "metal": F.lit("silver"), "weight": F.lit(1.0), "price": F.col("p_retailprice"), "spot": F.lit(250.0), "year": F.lit(1960), "tolerance": F.lit(40), "grade": F.lit("MS65")}
    return audit.removal_counts(audit.removed_by(t, audit.listing_rules(F.col("title"), wanted)), ["p_brand"])


@query(f"""WITH {_T}, s AS (SELECT p_partkey, least(100, 50 + CASE WHEN 1900 + p_partkey % 120 = 1960 THEN 15 ELSE -30 END + CASE WHEN {_METAL} = 'silver' THEN 10 WHEN {_METAL} <> 'silver' THEN -30 ELSE 0 END
+ CASE WHEN {_grade("title")} = 'MS65' THEN 15 WHEN {_grade("title")} <> 'MS65' THEN -20 ELSE 0 END + CASE WHEN abs({_WEIGHT} - 1.0::DOUBLE) / greatest({_WEIGHT}, 1.0::DOUBLE) < 0.05::DOUBLE THEN 25 WHEN abs({_WEIGHT} - 1.0::DOUBLE) / greatest({_WEIGHT}, 1.0::DOUBLE) < 0.2::DOUBLE THEN -15 WHEN {_WEIGHT} IS NOT NULL THEN -35 ELSE 0 END) AS score FROM t)
SELECT p_partkey, score, CASE WHEN score >= 85 THEN 'exact' WHEN score >= 65 THEN 'close' ELSE 'loose' END AS quality FROM s""")
def relevance_score_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit.relevance(F.col("title"), F.lit(1960), F.lit("silver"), F.lit("MS65"), F.lit(1.0))
    return titles(spark, sf_dir).select("p_partkey", s.alias("score")).withColumn("quality", audit.quality(F.col("score")))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name || ' ' || p_type, '(?i)(red|blue) .*promo')")
def regex_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.concat_ws(" ", "p_name", "p_type").rlike("(?i)(red|blue) .*promo")).select("p_partkey", "p_name", "p_type")


@query(f"""WITH {SALES}, p AS (SELECT part_key, any_value(brand) AS brand, median(price) AS v FROM sales GROUP BY part_key)
SELECT a.brand, a.part_key AS a, b.part_key AS b FROM p a JOIN p b ON a.brand = b.brand AND a.part_key < b.part_key AND abs(a.v - b.v) <= 0.01::DOUBLE * a.v""")
def pair_collision_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a brand whose values are within one per cent of each other. Values fall in bands of
    one per cent on a logarithmic scale, and only neighbour bands meet."""
    p = sales(spark, sf_dir).groupBy("part_key").agg(F.first("brand").alias("brand"), F.median("price").alias("v")).where("v > 0")
    band = F.floor(F.log("v") / 0.0101).cast("bigint")
    left = p.select("brand", F.col("part_key").alias("a"), F.col("v").alias("va"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = p.select("brand", F.col("part_key").alias("b"), F.col("v").alias("vb"), band.alias("band"))
    return left.join(right, ["brand", "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= F.col("va") * 0.01)).select("brand", "a", "b")


#: A made-up listing and what is wanted of it, from a part.
_COIN = """CASE p_partkey % 13 WHEN 0 THEN '1964 Washington quarter 90% silver' WHEN 1 THEN '1976 Kennedy half dollar clad' WHEN 2 THEN 'Franklin half dollar 1963' WHEN 3 THEN '2 pesos Libertad 1983' WHEN 4 THEN 'Libertad 1 oz silver colorized'
WHEN 5 THEN 'Silver Eagle Type 2 proof PCGS PR70' WHEN 6 THEN 'Perth Mint silver bar 10 oz' WHEN 7 THEN 'Geiger silver bar 10 oz' WHEN 8 THEN '1943 Jefferson war nickel silver' WHEN 9 THEN 'Buffalo nickel 1936 proof-like privy'
WHEN 10 THEN 'Elite Libertad proof gilded' WHEN 11 THEN 'Antiqued high relief Morgan 1 oz' ELSE concat_ws(' ', 'Peace dollar', p_name) END"""
_WISH = """CASE p_partkey % 7 WHEN 0 THEN 'Washington quarter' WHEN 1 THEN 'Kennedy half dollar' WHEN 2 THEN 'Jefferson nickel' WHEN 3 THEN 'colorized Libertad' WHEN 4 THEN 'Morgan dollar proof' WHEN 5 THEN 'antiqued gilded round' ELSE 'Peace dollar clad' END"""
_WISHED = f"w AS (SELECT p_partkey, {_COIN} AS title, lower({_COIN}) AS low, {_WISH} AS wish, lower({_WISH}) AS asked, 1930 + p_size AS year FROM part)"
_FAMILY = r"""list_filter([CASE WHEN regexp_matches({0}, '\breverse[\s-]+proof\b') THEN 'reverseProof' END, CASE WHEN regexp_matches(regexp_replace({0}, '\bproof[\s-]*like', '', 'g'), '\bproof\b') AND NOT regexp_matches({0}, '\breverse[\s-]+proof\b') THEN 'proof' END,
CASE WHEN {0} LIKE '%colorized%' THEN 'colorized' END, CASE WHEN {0} LIKE '%gilded%' THEN 'gilded' END, CASE WHEN {0} LIKE '%privy%' THEN 'privy' END, CASE WHEN {0} LIKE '%high relief%' THEN 'highRelief' END,
CASE WHEN {0} LIKE '%antiqued%' THEN 'antiqued' END, CASE WHEN {0} LIKE '%elite libertad%' THEN 'specialtyEdition' END], lambda x: x IS NOT NULL)"""


def wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_COIN).alias("title"), F.expr(_WISH).alias("wish"), (F.col("p_size") + 1930).alias("year"))


@query(f"""WITH {_WISHED}, f AS (SELECT *, {_FAMILY.format("low")} AS own, list_filter({_FAMILY.format("asked")}, lambda x: x IN ('colorized', 'antiqued', 'gilded', 'burnished', 'highRelief')) AS wanted FROM w),
g AS (SELECT *, CASE WHEN len(wanted) > 1 THEN 'ambiguous' ELSE wanted[1] END AS family FROM f)
SELECT p_partkey, array_to_string(list_sort(own), ',') AS families, family, CASE WHEN family IS NULL AND len(own) > 0 AND own <> ['privy'] AND (list_contains(own, 'specialtyEdition') OR NOT (asked LIKE '%proof%' AND list_has_any(own, ['proof', 'reverseProof']))) THEN 'variantMismatch'
WHEN family IS NOT NULL AND NOT (list_contains(own, family) AND len(list_filter(own, lambda x: x IN ('colorized', 'antiqued', 'gilded', 'burnished', 'highRelief'))) = 1 AND NOT list_contains(own, 'specialtyEdition') AND NOT regexp_matches(low, 'pcgs|proof')) THEN 'variantWrongColor' END AS verdict FROM g""")
def variant_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish families of titles, the one that is asked for, and whether it keeps the title out."""
    t, wish = F.col("title"), F.col("wish")
    family = variants.requested_family(wish)
    verdict = variants.variant_mismatch(t, family, F.lower(wish).rlike(r"\bproof\b"))
    return wishes(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(variants.families(t)), ",").alias("families"), family.alias("family"), verdict.alias("verdict"))


@query(f"""WITH {_WISHED} SELECT p_partkey,
CASE WHEN asked LIKE '%washington%' THEN false WHEN asked LIKE '%kennedy%' THEN low LIKE '%franklin%' WHEN asked LIKE '%jefferson%' THEN low LIKE '%buffalo%' WHEN asked LIKE '%morgan%' THEN low LIKE '%peace%' WHEN asked LIKE '%peace%' THEN low LIKE '%morgan%' ELSE false END AS series_conflict,
CASE WHEN asked LIKE '%quarter%' AND year > 1964 OR asked LIKE '%half dollar%' AND year > 1970 THEN low LIKE '%silver%' WHEN asked LIKE '%quarter%' OR asked LIKE '%half dollar%' THEN low LIKE '%clad%' WHEN asked LIKE '%nickel%' THEN year NOT BETWEEN 1942 AND 1945 AND (low LIKE '%silver%' OR low LIKE '%war%') ELSE false END AS composition,
low LIKE '%pesos%' AS small_change, NOT (low LIKE '%perth mint%') AS wrong_brand FROM w""")
def exclusive_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and metal contents that exclude each other, small change, and bars of another maker."""
    t, wish = F.col("title"), F.col("wish")
    return wishes(spark, sf_dir).select("p_partkey", variants.series_conflict(wish, t).alias("series_conflict"), variants.composition_mismatch(t, wish, F.col("year")).alias("composition"), variants.small_change(t).alias("small_change"), variants.lacks_words(t, F.lit("Perth Mint")).alias("wrong_brand"))
