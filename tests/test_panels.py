"""Matrices of many series, the look-up's self-test, lists of stale data sets, findings about valuations."""

import datetime

from pyspark.sql import functions as F

from hammerprice.operators import freshness, health, panels, resolve

NOW = "2024-06-30 00:00:00"
SCHEMA = "series string, grade string, title string, sold boolean, listing_type string, total double, url string, at timestamp, mode int"


def listings(spark, rows):
    day = datetime.datetime(2024, 6, 1)
    return spark.createDataFrame([(s, g, t, sold, kind, total, url, at or day, 1) for s, g, t, sold, kind, total, url, at in rows], SCHEMA)


def cells(spark, rows, **kw):
    out = panels.panels(listings(spark, rows), F.lit(NOW).cast("timestamp"), **kw).collect()
    return {(r["series"], r["year"], r["axis"]): r for r in out}


def test_cells_of_each_mode(spark):
    coin, bullion, bar = "Morgan Dollar", "Mexican Silver Libertad", "Silver Bar"
    old = datetime.datetime(2024, 3, 1)
    rows = [
        (coin, None, "1881-CC Morgan", True, None, 10.0, "a", None), (coin, "All", "1881 CC Morgan", True, None, 20.0, "b", None), (coin, None, "1881 CC Morgan", True, None, 99.0, "x", old),
        (coin, None, "1881 CC Morgan", False, None, 7.0, "c", None), (coin, None, "1881 CC Morgan", False, "FixedPrice", 7.0, "d", None), (coin, None, "1881 CC Morgan", False, "Auction", 1.0, "e", None),
        (coin, None, "Morgan without a year", True, None, 5.0, "f", None), (coin, None, None, True, None, 5.0, "f", None), (coin, None, "1900 Morgan", True, None, 0.0, "g", None), (coin, None, "1901 Morgan", True, None, None, "g", None),
        (bullion, None, "1975 Libertad MS69", True, None, 5.0, "h", None), (bullion, None, "1990 Libertad 5 pesos", True, None, 5.0, "i", None), (bullion, None, "1990 Libertad MS-69", True, None, 30.005, "j", None), (bullion, None, "1990 Libertad", None, None, 31.0, "k", None),
        (bar, None, "PAMP bar", True, None, 100.0, "l", None), (bar, None, "2001 bar", True, None, 90.0, "m", None), (None, None, "1990 coin", True, None, 90.0, "n", None),
    ]
    got = cells(spark, rows)
    assert set(got) == {(coin, 1881, "CC"), (coin, 1900, "P"), (coin, 1901, "P"), (bullion, 1990, "MS69"), (bullion, 1990, "RAW"), (bar, None, "PAMP"), (bar, None, "Generic")}
    cc = got[coin, 1881, "CC"]
    assert (cc["median"], cc["sold"], cc["cheapest"], cc["url"], cc["next_price"], cc["mode"]) == (15.0, 2, 7.0, "c", 7.0, "mint")
    for year in (1900, 1901):
        empty = got[coin, year, "P"]
        assert (empty["median"], empty["sold"], empty["cheapest"]) == (None, 0, None)
    assert got[bullion, 1990, "RAW"]["cheapest"] == 31.0 and got[bullion, 1990, "MS69"]["mode"] == "grade" and got[bar, None, "PAMP"]["mode"] == "brand"
    summary = {r["series"]: r for r in panels.panel_summaries(panels.panels(listings(spark, rows), F.lit(NOW).cast("timestamp"))).collect()}
    assert (summary[coin]["cells"], summary[coin]["priced"], summary[coin]["first_year"], summary[coin]["last_year"], summary[coin]["columns"]) == (3, 1, 1881, 1901, 2)
    assert cells(spark, []) == {}


def test_medians_equal_sorted_lists(spark):
    rows = [("Peace Dollar", None, f"{1921 + i % 3} Peace", True, None, float(i * 37 % 11 + 1), str(i), None) for i in range(100)]
    for (_, year, _), r in cells(spark, rows).items():
        p = sorted(x[5] for x in rows if x[2].startswith(str(year)))
        assert r["median"] == (p[(len(p) - 1) // 2] + p[len(p) // 2]) / 2 and r["sold"] == len(p)


def test_grades_lunar_years_and_key_dates(spark):
    lunar = "Perth Year of the Rooster silver"
    rows = [("Franklin Half", "Proof", "1960 half proof", True, None, 9.0, "a", None), ("Franklin Half", "Proof", "1960 half", True, None, 1.0, "b", None), ("Kennedy Half", "pf-65", "1970 S PR65", True, None, 4.0, "c", None), ("Kennedy Half", "pf-65", "1970 S PR66", True, None, 8.0, "d", None),
            (lunar, None, "2005 rooster", True, None, 1.0, "e", None), (lunar, None, "2017 rooster", True, None, 2.0, "f", None)]
    dates = spark.createDataFrame([(0, "Kennedy Half", 1970, "*", "semi")], "nth int, series string, year int, mint string, tier string")
    got = cells(spark, rows, dates=dates)
    assert {k: (v["median"], v["tier"]) for k, v in got.items()} == {("Franklin Half", 1960, "P"): (9.0, None), ("Kennedy Half", 1970, "S"): (4.0, "semi"), (lunar, 2017, "RAW"): (2.0, None)}


def test_search_words(spark):
    cases = [("Mexican Silver Libertad", None, None, "Mexico Silver Libertad 1 oz"), ("Canadian Gold Maple Leaf", 0.25, None, "Canada Gold Maple Leaf 1/4 oz"), ("Perth Lunar Series II Silver", 2.0, None, "Perth Lunar Series II silver 2 oz"),
             ("Perth Year of the Ox", None, "Proof", "Perth Lunar silver 1 oz Proof"), ("Silver Bar", None, None, "Silver Bar"), ("Morgan Proof", None, "PROOF", "Morgan Proof"), ("British half", None, "MS65", "Great Britain half"), (None, None, None, "")]
    df = spark.createDataFrame([c[:3] for c in cases], "series string, weight double, grade string")
    got = [r["k"] or "" for r in df.select(panels.keywords(F.col("series"), F.col("weight"), F.col("grade")).alias("k")).collect()]
    assert got == [c[3] for c in cases]


def test_self_test(spark):
    keys = spark.createDataFrame([(1, "1956 Franklin Half"), (2, "1881-CC Morgan"), (3, "1956-D Franklin Half"), (4, "zz"), (5, None)], "key_id int, term string")
    got = {(r["key_id"], r["asked"]): (r["found"], r["outcome"]) for r in resolve.self_test(keys).collect()}
    assert {a for k, a in got if k == 1} == {"1956 franklin half", "1956 franklin half dollar", "1956-d franklin half", "1956-s franklin half"}
    assert {a for k, a in got if k == 2} == {"1881-cc morgan", "1881-cc morgan dollar"}
    assert got[1, "1956 franklin half"] == (1, "same") and got[1, "1956-d franklin half"] == (3, "other") and got[2, "1881-cc morgan dollar"] == (2, "same")
    assert not [k for k in got if k[0] == 5] and all(o != "wrong year" for _, o in got.values())
    assert resolve.self_test(keys.limit(0)).count() == 0


def test_stale_lists(spark):
    rows = spark.createDataFrame([("a.b", None, None), ("c", 40, None), ("d(1)", 50, None), ("e", 3, None), ("f", 60, "dormant")], "term string, stale_days bigint, skip_reason string").withColumn("newest_sale", F.when(F.col("stale_days").isNotNull(), F.lit(NOW)))
    assert freshness.stale_pattern(rows, "term", "term", limit=2).first()[:] == (2, r"^a\.b$|^d\(1\)$")
    assert freshness.stale_pattern(rows.limit(0), "term", "term").first()[:] == (0, "")
    assert {r["reason"]: (r["n"], r["stale"]) for r in freshness.skip_counts(rows).collect()} == {"actionable": (4, 3), "dormant": (1, 1)}


def test_findings(spark):
    df = spark.createDataFrame([("x", 1.0, 9, None, None), (None, None, 9, None, None), (None, 100.0, 9, 10.0, 95.0), (None, 100.0, 4, 95.0, 99.0), (None, 100.0, None, None, 0.0), (None, 100.0, 9, 71.0, 80.0)], "error string, fmv double, comps int, gone double, melt double")
    found = health.findings(F.col("error"), F.col("fmv"), F.lit(False), F.col("comps"), F.col("gone"), F.col("melt"), F.lit(0.02), F.lit(0.1))
    got = [(r["f"], r["r"]) for r in df.select(found.alias("f"), health.rating(found).alias("r")).collect()]
    assert got == [(["RED:request-error"], "RED"), (["RED:no-fmv"], "RED"), ([], "GREEN"), (["YELLOW:thin-comps", "RED:high-attrition", "YELLOW:premium-low"], "RED"), ([], "GREEN"), (["YELLOW:attrition", "YELLOW:premium-high"], "YELLOW")]
    twice = spark.createDataFrame([("a", 100.0), ("a", 96.0), ("b", 100.0), ("b", 90.0), ("c", 1.0), ("d", None), ("d", 5.0), ("e", 0.0), ("e", 0.0)], "term string, fmv double")
    assert [(r["term"], r["delta"]) for r in health.unstable(twice, "term", "fmv").collect()] == [("b", 10.0)]


def test_listings_of_a_series_are_dealt(spark):
    """Listings meet what their series says by more than the series, so no task reads all of one."""
    row = spark.range(9).selectExpr("'Silver Bar' AS series", "'All' AS grade", "concat('PAMP bar ', id) AS title", "false AS sold", "CAST(NULL AS STRING) AS listing_type", "1.0D AS total", "CAST(id AS STRING) AS url", "timestamp'2024-01-01' AS at")
    out = panels.kept(row, F.lit("2024-06-01").cast("timestamp"), 90)
    assert out.count() == 9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan[plan.index("Join Inner") :].splitlines()[0]
