"""Titles, bars, ladders, intervals and the gram index on single cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hammerprice.operators import bars, dictionary, intervals, ladders, title


def said(spark, *titles):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, metal int")  # metal clashes with a part
    return {r["title"]: r for r in title.parsed(df, "title").collect()}


def test_grades(spark):
    cases = {
        "1916 Standing Liberty Quarter EF-40": "XF40", "1892 Barber Dime EF45": "XF45", "1956 Franklin Half PF65": "PR65", "2024 Gold Eagle PR70": "PR70", "1964 Half bu": "MS60", "1964 Half CHOICE BU": "MS63",
        "1964 Half gem bu": "MS65", "1964 Half SUPERB GEM BU": "MS67", "1881 S Morgan Dollar MS-65 BU": "MS65", "1958 Lincoln Cent UNC": "MS60", "1964 Kennedy Half MS65+": "MS65+", "1964 very good condition": "VG8",
        "1964 Half very fine silver": "VF20", "2023 1 oz Fine Silver Eagle": None, "1964 Kennedy Half Good condition": None, "1964 Half Good luck coin": None, "1881 Morgan Good": "G4", "1881-S Morgan Proof": "Proof",
        "1881-S Morgan Proof-Like": None, "1881-S Morgan Proof  Like": None, "Gem BU Proof": "Proof", "Choice BU Proof Set": "MS63", "1964 Half MS655": None, "": None, "2020 Silver Eagle PR70 DCAM": "PR70",
    }
    found = said(spark, *cases)
    assert {t: r["grade"] for t, r in found.items()} == cases
    assert found["Gem BU Proof"]["finish"] == "Proof" and found["Gem BU Proof"]["grade_number"] is None
    assert found["1964 Half bu"]["grade_source"] == "bu-term" and found["1881 Morgan Good"]["grade_source"] == "word-grade"
    assert found["2020 Silver Eagle PR70 DCAM"]["designation"] == "DCAM"


def test_weights_mints_and_sets(spark):
    found = said(spark, "2022 mexico half oz gold libertad", "2020 tenth oz proof", "2023 twentieth ounces gold", "1964 Kennedy half dollar", "2020 1/2 oz Gold Eagle", "1/0 oz", "bar .5g", "bar 31.1035 grams", "1956 D half dollar", "1881-CC Morgan", "dollar S 1900", "2020 silver proof set", "2020 premier  silver proof set", "1999 uncirculated set", "tube of dimes", "2021 eagle type 2")
    weights = {t: r["weight"] for t, r in found.items()}
    assert weights["2022 mexico half oz gold libertad"] == 0.5 and weights["2020 tenth oz proof"] == 0.1 and weights["2023 twentieth ounces gold"] == 0.05
    assert weights["1964 Kennedy half dollar"] is None and weights["2020 1/2 oz Gold Eagle"] == 0.5 and weights["1/0 oz"] is None
    assert weights["bar .5g"] == pytest.approx(0.5 / 31.1035) and weights["bar 31.1035 grams"] == pytest.approx(1)
    assert [found[t]["mint"] for t in ("1956 D half dollar", "1881-CC Morgan", "dollar S 1900", "tube of dimes")] == ["D", "CC", "S", None]
    sets = {t: (r["set_type"], r["series"]) for t, r in found.items() if r["set_type"]}
    assert sets == {"2020 silver proof set": ("silver", "US Silver Proof Set"), "2020 premier  silver proof set": ("premier-silver", "US Premier Silver Proof Set"), "1999 uncirculated set": ("mint-uncirculated", "US Mint Set")}
    assert found["tube of dimes"]["is_roll"] and found["2021 eagle type 2"]["label"] == "Type 2" and found["2020 silver proof set"]["grade"] is None


def test_series_and_exclusions(spark):
    found = said(spark, "2026 Semiquincentennial half dollar", "perth lunar silver year of the ox 2021", "Year of the Ox perth silver", "wedge-tailed eagle -proof -gold", "2020 Canadian Silver Maple Leaf", "Silver Maple", "something else", None)
    assert {t: r["series"] for t, r in found.items()} == {"2026 Semiquincentennial half dollar": "Semiquincentennial Half Dollar", "perth lunar silver year of the ox 2021": "Perth Lunar", "Year of the Ox perth silver": "Perth Silver Year Of The Ox", "wedge-tailed eagle -proof -gold": "Wedge-Tailed Eagle", "2020 Canadian Silver Maple Leaf": "Canadian Silver Maple Leaf", "Silver Maple": "Silver Maple", "something else": None, None: None}
    eagle = found["wedge-tailed eagle -proof -gold"]
    assert eagle["exclusions"] == ["proof", "gold"] and eagle["metal"] is None and eagle["grade"] is None and eagle["plain"] == "wedge-tailed eagle"


def test_own_names_and_no_names(spark):
    names = spark.createDataFrame([(2, "eagle", "Eagle"), (1, "gold eagle", "Gold Eagle"), (0, "x", "X")], "nth int, name string, shown string")
    df = spark.createDataFrame([("a Gold Eagle",), ("eagle x",), ("-eagle",)], "t string")
    assert {r["t"]: r["series"] for r in title.parsed(df, "t", names).collect()} == {"a Gold Eagle": "Gold Eagle", "eagle x": "X", "-eagle": None}
    assert {r["series"] for r in title.parsed(df, "t", names.limit(0)).collect()} == {None}


def test_keywords(spark):
    df = spark.createDataFrame([(1892, "S", "Mexican Silver Libertad", None, "MS65", None, 0.25, "First Strike"), (None, None, None, None, "Proof", None, None, None), (2020, None, "Platinum Eagle", None, "Proof", "DCAM", 2.0, ""), (None, None, "Morgan", None, None, None, None, None)], "year int, mint string, series string, finish string, grade string, designation string, weight double, label string")
    row = {c: F.col(c) for c in ("year", "mint", "series", "finish", "grade", "designation")}
    got = [r[0] for r in df.select(title.keywords(row, F.lit("raw query"), F.col("weight"), F.col("label"))).collect()]
    assert got == ["1892-S Mexico Silver Libertad MS65 1/4 oz First Strike -gold", "raw query", "2020 Platinum Eagle Proof DCAM 2 oz -silver -gold", "raw query"]


def test_bars(spark):
    df = spark.createDataFrame([("PAMP Suisse Lady Fortuna and Geiger bar", " pamp  suisse", "Fortuna"), ("pamp bull", "PAMP", "Zodiac - Taurus"), ("perth mint dragon ball", "Perth Mint", "Cast"), ("perth mint dragon", "Perth Mint", "Cast"), (None, None, None)], "title string, own string, line string")
    t, own = F.col("title"), bars.canonical_maker(F.col("own"))
    rows = df.select(bars.makers(t), bars.line_in_title(own, t), bars.line_in_search(own, t), bars.mismatch(t, own, F.col("line"))).collect()
    assert [tuple(r) for r in rows] == [(["PAMP", "Geiger"], "Fortuna", "Fortuna", "barBrandMismatch"), (["PAMP"], None, "Zodiac - Taurus", None), (["Perth Mint"], None, None, None), (["Perth Mint"], "Dragon", "Dragon", "barSeriesMismatch"), ([], None, None, None)]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_held_names(spark, size):
    r = random.Random(size)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(120)] + [None, "", "a"]
    names = list({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)}) + [None, "", "abcabcabcabcabcabc"]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in names], "n string")
    got = sorted((x["t"], x["n"]) for x in dictionary.held_names(t, n, "t", "n", size).collect())
    assert got == sorted((x, y) for x in set(texts) if x for y in set(names) if y and y in x)
    both = sorted((x["t"], x["n"]) for x in dictionary.either_way(t, n, "t", "n", size).collect())
    assert both == sorted((x, y) for x in set(texts) if x is not None for y in set(names) if y is not None and ((y and y in x) or (x and x in y)))


def test_no_nested_loop(spark):
    df = spark.range(5000).selectExpr("concat('name ', id) AS name")
    series = spark.range(300).selectExpr("concat('name ', id * 7) AS series", "array(concat('alias ', id)) AS aliases")
    plan = ladders.series_names(df, series)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_join(spark, width):
    r = random.Random(width)
    rules = [(r.choice("ab"), r.choice([None, r.randint(-50, 100)]), r.choice([None, r.randint(-50, 150)]), r.randint(0, 3), f"r{i:02d}") for i in range(60)]
    rows = [(i, r.choice("abc"), r.choice([None, r.randint(-60, 160)])) for i in range(300)]
    df, dim = spark.createDataFrame(rows, "id int, k string, v int"), spark.createDataFrame(rules, "k string, low int, high int, priority int, rule string")
    got = {x["id"]: x["rule"] for x in intervals.interval_join(df, dim, ["k"], "v", ["rule"], width).collect()}
    least = min(v for _, _, v in rows if v is not None)

    def best(k, v):
        own = [(p, float("inf") if lo is None or hi is None else hi - lo, -max(least if lo is None else lo, least), n) for g, lo, hi, p, n in rules if g == k and v is not None and (lo is None or lo <= v) and (hi is None or v <= hi)]
        return min(own)[3] if own else None

    assert got == {i: best(k, v) for i, k, v in rows}
    assert intervals.interval_join(df.limit(0), dim, ["k"], "v", ["rule"]).collect() == []


def test_many_rules_are_no_lists(spark):
    """4,000 rules over the same values: each block keeps one, and no list of them is made (which grew with the square)."""
    df = spark.range(2000).selectExpr("id", "'a' AS k", "id % 55 AS v")
    dim = spark.range(4000).selectExpr("'a' AS k", "id % 50 AS low", "id % 50 + id % 23 AS high", "id % 3 AS priority", "concat('r', id) AS rule")
    out = intervals.interval_join(df, dim, ["k"], "v", ["rule"])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    rules = [(i % 3, i % 23, -(i % 50), f"r{i}", i % 50, i % 50 + i % 23) for i in range(4000)]
    best = {v: min((r for r in rules if r[4] <= v <= r[5]), default=(None,) * 4)[3] for v in range(55)}
    assert {(r["v"], r["rule"]) for r in out.select("v", "rule").distinct().collect()} == set(best.items())


def test_half_dollars(spark):
    df = spark.createDataFrame([(y,) for y in (1793, 1794, 1807, 1839, 1964, 1970, 1971, 1976, 2026, 2101, None)], "y int")
    got = {r["y"]: (r["design"], r["composition"], r["suffix"]) for r in intervals.half_dollars(df, "y").collect()}
    assert got[1807] == ("Capped Bust", "89.24% Silver", None) and got[1839] == ("Seated Liberty", "90% Silver", None)
    assert got[1964] == ("Kennedy", "90% Silver", None) and got[1970][1] == "40% Silver" and got[2026] == ("Kennedy", "Copper-Nickel Clad", "Semiquincentennial")
    assert got[1793] == got[2101] == got[None] == ("Unknown", "Unknown", None)


def test_key_dates(spark):
    dates = spark.createDataFrame([(0, "Morgan Dollar", 1893, "S", "key"), (1, "Franklin Half", 0, "*", "any"), (2, "Morgan Dollar", 1889, "*", "year"), (3, "Standing Liberty Quarter", 1916, "", "fuzzy")], "nth int, series string, year int, mint string, tier string")
    items = spark.createDataFrame([(1, "morgan dollar", 1893, "s"), (2, "Morgan Dollar", 1889, "CC"), (3, "franklin half", 1950, None), (4, "standing liberty", 1916, None), (5, "standing liberty", 1917, None), (6, None, 1893, "S"), (7, " morgan dollar vam ", 1893, "S"), (7, " morgan dollar vam ", 1893, "S")], "id int, series string, year int, mint string")
    got = sorted((r["id"], r["tier"], r["step"]) for r in ladders.key_dates(items, dates).collect() if r["tier"])
    assert got == [(1, "key", 0), (2, "year", 1), (3, "any", 2), (4, "fuzzy", 3), (7, "key", 3), (7, "key", 3)]


def test_mintages(spark):
    mints = spark.createDataFrame([("ase", 2020, "P", 10, 0), ("ase", 2020, "W", 9, 1), ("ase proof", 2020, "W", 5, 2), ("ase proof", 2020, "S", 4, 3), ("ase 1/2 oz", 2020, "P", 2, 4), ("ase", 2021, "P", None, 5)], "series string, year int, mint string, mintage long, nth int")
    cases = [("ASE", 2020, None, None, None, 10), ("ase", 2020, "w", 1.0, "Burnished", 9), ("ase", 2020, None, None, "Proof", 5), ("ase", 2020, "s", None, "Reverse Proof", 4), ("ase", 2021, None, None, "Proof", None), ("ase", 2020, "P", 0.5, None, 2), ("ase", 2020, "W", 0.5, None, 9), ("ase", 2020, "D", None, None, None), ("ase", 2021, None, None, None, None), (None, 2020, None, None, None, None)]
    items = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "id int, series string, year int, mint string, weight double, finish string")
    assert {r["id"]: r["mintage"] for r in ladders.mintages(items, mints).collect()} == {i: c[5] for i, c in enumerate(cases)}
