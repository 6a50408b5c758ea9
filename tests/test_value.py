"""Valuation, pools and look-ups on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from hammerprice.operators import audit, holdings, robust, value

COLUMNS = "query_id int, sold_median double, n long, sd double, sold_share double, spot double, wholesale double, guide double, auction double, bullion boolean, proof boolean, certified boolean, tier string, appeal double"


def test_fair_value(spark):
    rows = [
        (1, 30.0, 25, 1.0, 1.0, 25.0, None, None, None, True, False, False, "mid", None),
        (2, 80.0, 3, 1.0, 0.0, 25.0, None, None, None, True, False, False, "mid", None),
        (3, None, None, None, None, 25.0, 22.0, None, None, True, False, False, "mid", None),
        (4, None, None, None, None, 25.0, 10.0, None, None, True, False, False, "mid", None),
        (5, 100.0, 5, 10.0, 0.2, None, 50.0, None, None, False, False, False, "mid", 1.5),
        (6, 100.0, 5, 10.0, 1.0, None, None, 200.0, None, False, False, True, "low", None),
        (7, None, None, None, None, None, None, None, None, False, True, False, "mid", None),
        (8, None, None, None, None, 25.0, None, 40.0, None, True, True, False, "mid", None),
    ]
    out = {r["query_id"]: (r["fmv"], r["method"], r["label"]) for r in value.fair_value(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert out == {
        1: (30.0, "bullion-spot-premium", "sold-data"),
        2: (50.0, "bullion-spot-premium", "asking-prices-only"),
        3: (22.9, "bullion-greysheet-anchor", "metal-only"),
        4: (25.0, "bullion-spot-only", "metal-only"),
        5: (133.34, "raw-blend", "mostly-asking"),
        6: (113.33, "certified-blend", "sold-data"),
        7: (None, None, "metal-only"),
        8: (40.0, "raw-blend", "guide-only"),
    }


def test_pools(spark):
    rows = [(1, "raw", True)] * 10 + [(2, "raw", True)] * 10 + [(2, "graded", True), (3, "raw", True)]
    df = spark.createDataFrame(rows, "query_id int, pool string, sold boolean").withColumn("guide", F.lit(None).cast("double"))
    got = value.pool_comps(df, F.lit("graded"), F.col("guide")).groupBy("query_id", "pool").count().collect()
    assert sorted(map(tuple, got)) == [(1, "raw", 10), (2, "graded", 1)]


def test_cohort(spark):
    comps = spark.createDataFrame([("m", y, float(y)) for y in (1990, 1991, 1991, 1992, 1993, 1994)], "cohort string, year int, price double")
    q = spark.createDataFrame([(1, "m", 1990), (2, "m", 1999)], "query_id int, cohort string, year int")
    got = sorted((r["query_id"], r["year"], r["composite"]) for r in value.with_cohort(q, comps).collect())
    assert got == [(1, 1990, False), (1, 1991, True), (1, 1991, True), (1, 1992, True), (1, 1993, True)]


def test_sold_prices(spark):
    now = dt.datetime(2024, 6, 30)
    rows = [(1, 10.0, now - dt.timedelta(1), 100), (1, 20.0, now - dt.timedelta(900), 100), (1, 30.0, now - dt.timedelta(900), 100)]
    df = spark.createDataFrame(rows, "query_id int, total_usd double, sold_date timestamp, match_score int").withColumn("sold", F.lit(True))
    r = value.sold_prices(df, F.lit(now), 90).first()
    assert (r["sold_median"], r["plain_median"], r["n"]) == (10.0, 20.0, 3)


def test_priority_lookup_and_patch(spark):
    dim = spark.createDataFrame([("a|1", 1.0), ("a", 2.0)], "key string, v double")
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3)], "id int, x string, y int")
    out = holdings.priority_lookup(df, ["id"], dim, "key", [F.concat_ws("|", "x", "y"), F.col("x")], ["v"])
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 1.0), (2, 2.0), (3, None)]
    meta = spark.createDataFrame([("k", 1, "x")], "key string, n int, s string")
    patch = spark.createDataFrame([("k", 2, None), ("new", None, "y")], "key string, n int, s string")
    assert sorted(map(tuple, holdings.patched(meta, patch, "key").collect())) == [("k", 2, "x"), ("new", None, "y")]


def test_removal_takes_the_first_rule(spark):
    df = spark.createDataFrame([("1921 gold replica", 10), ("1921 gold", 10), ("1921 silver", 50), ("token", None), ("1980 silver", 50)], "title string, score int")
    rules = audit.listing_rules(F.col("title"), {"score": F.col("score"), "metal": F.lit("silver"), "year": F.lit(1921)})
    got = [r["removed_by"] for r in audit.removed_by(df, rules).collect()]
    assert got == ["lowRelevance", "lowRelevance", None, "denied", "yearMismatch"]


def test_medians_keep_all_digits(spark):
    """Half of the weight is missed by less than the seven digits that a product of wide decimals had."""
    df = spark.sql("SELECT * FROM VALUES ('k', 1.0D, 0.123456712BD), ('k', 2.0D, 0.123456730BD) AS t(k, v, w)").withColumn("w", F.col("w").cast("decimal(18,9)"))
    assert robust.weighted_median(df, ["k"], "v", "w").first()["weighted_median"] == 2.0
    assert robust.fair_values(df, ["k"], "v", F.col("w")).first()["fair_value"] == 2.0


def test_valuation_far_above_wholesale(spark, tmp_path):
    """Sales over 28 times the retail price of a bullion part, as its SQL has them."""
    import duckdb

    from hammerprice.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT 3::BIGINT AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'PROMO' AS p_type, 7 AS p_size, 900.0::DOUBLE AS p_retailprice")
    con.execute("CREATE TABLE lineitem AS SELECT i::BIGINT AS l_orderkey, 3::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1 AS l_linenumber, 1.0::DOUBLE AS l_quantity, 90000.0::DOUBLE + i AS l_extendedprice, TIMESTAMP '1999-01-01' AS l_shipdate FROM range(5) r(i)")
    for name in ("part", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = queries()["valuation_by_part"](spark, str(tmp_path)).first()
    assert (got["part_key"], got["fmv"], got["method"]) == con.execute(oracle_sql()["valuation_by_part"]).fetchone()


def test_cohorts_are_counted_before_they_meet(spark):
    """No row is spread over the years around it."""
    from hammerprice.queries import queries

    plan = queries()["cohort_composite"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join ") <= 2
