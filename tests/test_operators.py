"""Operators against plain Python on small and random inputs."""

import datetime as dt
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from hammerprice.functions import numbers, text
from hammerprice.operators import freshness, merge, resolve, robust
from hammerprice.operators.lookup import as_of_join, token_matches

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


def test_money(spark):
    assert one(spark, numbers.money(F.col("v")), v=1.005) == 1.0
    assert one(spark, numbers.money(F.col("v")), v=2.345) == 2.35


def test_blend(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(numbers.blend([(F.col("a"), 0.75), (F.col("b"), 0.25)])).collect()] == [1.5, 1.0, None]


def test_keys(spark):
    def key(x):
        return one(spark, text.search_key(F.col("t")), t=x)

    assert key("2025 Mexico 1/2 oz Silver Libertad -gold") == key("half oz 2025 mexican silver libertad")
    assert key("1956-D Franklin MS-65") == "1956 d franklin ms65"
    assert key("") == ""


def test_weight_metal_grade(spark):
    for title, oz in (("1/10 oz gold", 0.1), ("31.1035 g silver", 1.0), ("half oz", 0.5), ("1 kilo silver", 32.1507), ("500 oz", None), ("dollar", None)):
        assert one(spark, text.weight(F.col("t")), t=title) == oz
    assert one(spark, text.metal(F.col("t")), t="gold plated silver eagle") == "silver"
    assert one(spark, text.grade(F.col("t")), t="1921 Morgan pf-69") == "PR69"
    assert one(spark, text.pool(F.col("t")), t="Proof-like dollar") == "raw"


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.integers(0, 5)), min_size=1, max_size=30))
def test_weighted_median(spark, rows):
    df = spark.createDataFrame([(k, float(v), w) for k, v, w in rows], "k int, v double, w int")
    got = {r["k"]: r["weighted_median"] for r in robust.weighted_median(df, ["k"], "v", "w").collect()}
    for k in {r[0] for r in rows}:
        own = sorted((v, w or 1) for g, v, w in rows if g == k)
        half, run = sum(w for _, w in own) / 2, 0
        for v, w in own:
            run += w
            if run >= half:
                break
        assert got[k] == v


@few
@given(st.lists(st.integers(0, 300), min_size=1, max_size=25))
def test_outliers(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    kept = sorted(r["v"] for r in robust.mad_flag(df, ["k"], "v").where("kept").collect())
    med = statistics.median(values)
    spread = statistics.median(abs(v - med) for v in values) * 1.4826 * 3.5
    assert kept == sorted(float(v) for v in values if len(values) < 4 or med - spread <= v <= med + spread)
    s = sorted(values)
    q1, q3 = s[int(len(s) * 0.25)], s[int(len(s) * 0.75)]
    kept = sorted(r["v"] for r in robust.iqr_flag(df, ["k"], "v").where("kept").collect())
    assert kept == [float(v) for v in s if len(s) < 4 or q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]


@few
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.sampled_from("xyz")), min_size=1, max_size=15))
def test_dedup_or(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, id string, p string")
    got = sorted(r["i"] for r in merge.dedup_or(df, "id", "p", "i").collect())
    ids, prints, want = set(), set(), []
    for i, (a, b) in enumerate(rows):
        if a and a in ids:
            continue
        if a:
            ids.add(a)
        if b in prints:
            continue
        prints.add(b)
        want.append(i)
    assert got == want


@few
@given(st.sets(st.integers(0, 60), max_size=8), st.lists(st.integers(0, 60), min_size=1, max_size=8))
def test_as_of(spark, series, asked):
    day = dt.date(2024, 1, 1)
    s = spark.createDataFrame([("m", day + dt.timedelta(d), float(d)) for d in series], "k string, d date, price double")
    q = spark.createDataFrame([(i, "m", day + dt.timedelta(a)) for i, a in enumerate(asked)], "i int, k string, t date")
    got = {r["i"]: r["price"] for r in as_of_join(q, s, ["k"], "t", "d", "price").collect()}
    for i, a in enumerate(asked):
        prior = [d for d in series if d <= a]
        at = max(prior) if prior else min(series, default=None)
        assert got[i] == (float(at) if at is not None and abs(a - at) <= 7 else None)


def test_token_matches_brute_force(spark):
    words = "silver gold eagle half oz 1881 1882 morgan dollar proof bu lunar tiger perth".split()
    terms = [sorted({words[(i * k + k) % len(words)] for i in range(2 + k % 5)}) for k in range(1, 40)]
    q = spark.createDataFrame(list(enumerate(terms[::2])), "query_id int, words array<string>")
    k = spark.createDataFrame(list(enumerate(terms[1::2])), "key_id int, words array<string>")
    got = {(r["query_id"], r["key_id"]) for r in token_matches(q, k).collect()}
    want = set()
    for i, a in enumerate(terms[::2]):
        for j, b in enumerate(terms[1::2]):
            hits = len(set(a) & set(b))
            if max(hits / len(a), hits / len(b)) >= 0.65 and (hits / len(a) + hits / len(b)) / 2 > 0.55:
                want.add((i, j))
    assert got == want


def test_resolve(spark):
    q = spark.createDataFrame([(1, "1921 Morgan Silver Dollar"), (2, "Silver Eagle 1 oz"), (3, "1921 Morgan Dollar MS65")], "query_id int, term string")
    k = spark.createDataFrame([(1, "1921 morgan silver dollar"), (2, "1922 morgan silver dollar"), (3, "silver eagle 1 oz proof"), (4, "silver eagle 1oz"), (5, "1921 morgan dollar ms65"), (6, "1921 morgan dollar ms63")], "key_id int, term string")
    assert {r["query_id"]: r["key_id"] for r in resolve.resolve(q, k).collect()} == {1: 1, 2: 4, 3: 5}


def test_upsert_and_empty(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, a string, b int")
    b = spark.createDataFrame([(1, None, 2), (2, "y", None)], "k int, a string, b int")
    assert sorted(map(tuple, merge.upsert(a, b, ["k"]).collect())) == [(1, "x", 2, False), (2, "y", None, True)]
    assert robust.summary(a.where("false"), ["k"], "b").count() == 0


def test_freshness(spark):
    now = dt.datetime(2024, 6, 30)
    rows = [(1, 50, now - dt.timedelta(40), None, 1), (2, 0, None, None, 0), (3, 4, now - dt.timedelta(1), now - dt.timedelta(5), 1), (4, 50, now - dt.timedelta(20), now - dt.timedelta(3), 1)]
    df = spark.createDataFrame(rows, "k int, comp_count int, newest_sale timestamp, last_refresh timestamp, refresh_count int")
    for c, kind in (("no_data_at", "timestamp"), ("no_data_count", "int"), ("dry", "int"), ("file_exists", "boolean")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    df = df.withColumn("last_new", F.lit(3))
    got = {r["k"]: (r["freshness"], r["depth"], r["action"], r["priority"]) for r in freshness.classified(df, F.lit(now)).collect()}
    assert got == {1: ("very-stale", "viable", "refresh", "P0"), 2: ("missing", "untested", "initial-fetch", "P2"), 3: ("fresh", "thin", "thin-wait", None), 4: ("stale", "viable", "recently-confirmed-stale", None)}
