"""Intents, compositions and ghost keys on the driver tables, with SQL twins written out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intent
from ..registry import query, table

_ASKED = """CASE p_partkey % 16 WHEN 0 THEN '1oz silver eagle -gold proof' WHEN 1 THEN 'tenth oz gold eagle MS70' WHEN 2 THEN 'krugerrand 1980' WHEN 3 THEN 'Morgan dollar 1921 MS 65'
WHEN 4 THEN 'indian head quarter eagle' WHEN 5 THEN 'Lincoln cent roll' WHEN 6 THEN '10oz silver bar' WHEN 7 THEN 'silver round' WHEN 8 THEN 'us mint set 1976' WHEN 9 THEN 'junk silver lot'
WHEN 10 THEN '90 silver dimes 1 face value' WHEN 11 THEN 'half oz libertad' WHEN 12 THEN 'platinum eagle' WHEN 13 THEN '5oz lunar dragon' WHEN 14 THEN 'saint-gaudens double eagle' ELSE p_name END"""


@query(f"""WITH w AS (SELECT p_partkey, p_partkey % 16 AS k, lower({_ASKED}) AS low FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'silver' WHEN 1 THEN 'gold' WHEN 2 THEN 'gold' WHEN 3 THEN 'silver' WHEN 6 THEN 'silver' WHEN 7 THEN 'silver' WHEN 9 THEN 'silver' WHEN 10 THEN 'silver' WHEN 11 THEN 'silver' WHEN 12 THEN 'platinum' WHEN 13 THEN 'silver' WHEN 14 THEN 'gold'
 WHEN 15 THEN CASE WHEN regexp_matches(low, '\\bgold\\b') THEN 'gold' WHEN regexp_matches(low, '\\bsilver\\b') THEN 'silver' END END AS metal,
CASE k WHEN 0 THEN 'bullion-proof' WHEN 1 THEN 'bullion-fractional-gold' WHEN 2 THEN 'bullion' WHEN 3 THEN 'silver-numismatic' WHEN 4 THEN 'gold-numismatic' WHEN 5 THEN 'base-metal' WHEN 6 THEN 'bar' WHEN 7 THEN 'bar' WHEN 8 THEN 'set' WHEN 9 THEN 'junk-silver'
 WHEN 10 THEN 'junk-silver-denom' WHEN 11 THEN 'bullion-fractional-silver' WHEN 12 THEN 'bullion' WHEN 13 THEN 'bullion-multioz' WHEN 14 THEN 'gold-numismatic' ELSE 'unknown' END AS composition,
CASE WHEN k IN (1, 3) THEN 'graded' ELSE 'raw' END AS graded, CASE k WHEN 6 THEN 'bar' WHEN 7 THEN 'round' ELSE 'coin' END AS form FROM w""")
def composition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metal, composition, grading and form of search terms."""
    asked = F.expr(_ASKED)
    columns = [intent.metal_profile(asked)["metal"].alias("metal"), intent.composition(asked).alias("composition"), intent.graded(asked).alias("graded"), intent.form(asked).alias("form")]
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


_WISH = "CASE o_orderkey % 4 WHEN 0 THEN 'MS65' WHEN 1 THEN '' WHEN 2 THEN 'PR70' END"
_FINISH = "CASE o_orderkey % 3 WHEN 0 THEN ' Reverse Proof ' WHEN 1 THEN '  ' END"


@query(f"""WITH w AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS is_set, nullif({_WISH}, '') AS g1, CASE WHEN o_orderkey % 5 = 0 THEN 'AU58' END AS g2, CASE WHEN o_orderkey % 6 = 1 THEN 'Proof' END AS g3,
 nullif(trim({_FINISH}), '') AS finish, CASE WHEN o_orderkey % 5 = 0 THEN 'PR69DCAM' WHEN o_orderkey % 11 = 0 THEN 'CAM' END AS designation FROM orders)
SELECT o_orderkey, CASE WHEN NOT is_set THEN coalesce(g1, g2, g3) END AS grade, finish, designation,
NOT is_set AND (o_orderkey % 13 = 0 OR finish IS NOT NULL OR coalesce(designation = 'PR69DCAM', false) OR coalesce(coalesce(g1, g2, g3) IN ('PR70', 'Proof'), false) OR g3 IS NOT NULL) AS is_proof FROM w""")
def merged_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One intent of a form, a look-up and a parsed text."""
    n = F.col("o_orderkey")
    blank = F.lit(None).cast("string")

    def given(grade, finish, designation, proof):
        return F.struct(grade.alias("grade"), finish.alias("finish"), designation.alias("designation"), proof.alias("is_proof"))

    form = given(F.expr(_WISH), F.expr(_FINISH), F.when(n % 11 == 0, "CAM"), n % 13 == 0)
    lookup = F.when(n % 5 == 0, given(F.lit("AU58"), blank, F.lit("PR69DCAM"), F.lit(None).cast("boolean")))
    parsed = given(F.when(n % 6 == 1, "Proof"), blank, blank, F.lit(None).cast("boolean"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", intent.merged(form, lookup, parsed, n % 7 == 0, F.lit(False)).alias("x"))
    return found.select("o_orderkey", "x.grade", "x.finish", "x.designation", "x.is_proof")


_META = """SELECT CAST(1000 + floor(p_partkey / 8) AS INT) || CASE p_partkey % 8 WHEN 0 THEN ' mexican silver libertad 1oz' WHEN 1 THEN ' Mexican silver libertad 1oz' WHEN 2 THEN ' mexico 1oz silver libertad' WHEN 3 THEN '-d morgan dollar'
WHEN 4 THEN ' d morgan dollar' WHEN 5 THEN ' silver eagle 1oz' WHEN 6 THEN ' silver eagle' ELSE ' token' END AS key, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS deep_at, CASE WHEN p_partkey % 4 = 1 THEN p_partkey END AS page1_at,
CASE WHEN p_partkey % 5 = 2 THEN p_partkey END AS last_refresh, p_partkey % 97 AS newest, p_partkey % 89 AS oldest, CASE WHEN p_partkey % 8 IN (4, 6, 7) THEN p_size % 2 ELSE p_size % 5 END AS n"""


def _group(name: str, source: str, by: str) -> str:
    held = ", ".join(f"arg_min({c}, r) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("deep_at", "page1_at", "last_refresh"))
    return f"""{name} AS (SELECT arg_min(key, r) AS key, {held}, max(newest) AS newest, min(oldest) AS oldest, max(n) AS n
 FROM (SELECT *, {by} AS g, row_number() OVER (PARTITION BY {by} ORDER BY (key <> lower(key))::INT, n DESC, key) AS r FROM {source}) GROUP BY g)"""


_LATER = ", ".join(f"coalesce(r.{c}, g.{c}) AS {c}" for c in ("deep_at", "page1_at", "last_refresh"))


@query(f"""WITH meta AS ({_META} FROM part), {_group("one", "meta", "lower(key)")}, {_group("two", "one", "list_sort(string_split(replace(lower(key), 'mexican', 'mexico'), ' '))")},
g AS (SELECT *, CASE WHEN regexp_matches(key, '^[0-9]{{4}} d ') THEN replace(key, ' d ', '-d ') ELSE key || ' 1oz' END AS target FROM two WHERE n = 0 AND key NOT LIKE '%oz%')
SELECT r.key, {_LATER}, r.newest, r.oldest, r.n FROM two r LEFT JOIN g ON g.target = r.key WHERE r.n > 0""")
def pruned_ghost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without rows are merged into the spelling that has some, or go."""
    meta = table(spark, sf_dir, "part").selectExpr(*[c.strip() for c in _columns(_META)])
    return intent.pruned(meta, F.lower)


def _columns(select: str) -> list[str]:
    """The expressions of ``_META``, one for each name."""
    names = ("key", "deep_at", "page1_at", "last_refresh", "newest", "oldest", "n")
    rest, out = select.removeprefix("SELECT "), []
    for name in names:
        own, _, rest = rest.partition(f" AS {name}")
        out.append(f"{own.lstrip(', ')} AS {name}")
    return out
