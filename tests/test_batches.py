"""Cascades item by item, running totals, pilots, stores and merged data sets against plain loops."""

import datetime as dt
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from hammerprice.operators import cascade, pilot, ranks, resolve, robust
from hammerprice.queries import oracle_sql, queries
from hammerprice.sources import stores

NOW = dt.datetime(2024, 6, 1)
COMPS = "dataset int, pool string, item_id int, price double, score int, sold_at timestamp, kept boolean, cohort string, year int"
QUERIES = "query_id int, dataset int, pool string, asked int, least int, cohort string, year int"


def listings(seed, n=260):
    r = random.Random(seed)
    return [(r.randrange(8), r.choice(["raw", "raw", "proof"]), seed * 1000 + r.randrange(200), float(r.randint(10, 99)), r.randint(0, 100), r.choice([None, *[NOW - dt.timedelta(days=r.randint(0, 900)) for _ in range(9)]]), r.random() < 0.8, r.choice("xy"), r.randint(1990, 1999)) for _ in range(n)]


def frames(spark, queries, sources):
    seen = [list({c[2]: c for c in s}.values()) for s in sources]  # an item is one listing
    return spark.createDataFrame(queries, QUERIES), [spark.createDataFrame(s, COMPS) for s in seen]


def test_batch_is_item_by_item(spark):
    queries = [(i, i % 9, "raw" if i % 3 else "proof", (90, 180, 200, 365)[i % 4], (1, 3, 8, 25)[i % 4], "xy"[i % 2], 1990 + i if i % 5 else None) for i in range(10)]
    q, (a, b, c) = frames(spark, queries, [listings(1), listings(2), listings(3)])
    now = F.lit(NOW)

    def all_of(q):
        comps, ways = cascade.cascade(q, a, b, c, now)
        return sorted(map(str, comps.collect())), sorted(map(str, ways.collect()))

    whole = all_of(q)
    parts = [all_of(q.where(F.col("query_id") == i)) for i in (0, 3, 4, 7)]
    for i, (comps, ways) in zip((0, 3, 4, 7), parts):
        assert comps == [x for x in whole[0] if x.startswith(f"Row(query_id={i},")] and ways == [x for x in whole[1] if x.startswith(f"Row(query_id={i},")]
    assert all_of(q.limit(0)) == ([], [])


def test_windows(spark):
    sales = [(1, "raw", i, 1.0, 1, NOW - dt.timedelta(days=d) if d is not None else None, True, "x", 1990) for i, d in enumerate([10, 100, 170, 200, 300, 400, 800, None])]
    q, (a,) = frames(spark, [(i, 1, "raw", asked, least, "x", None) for i, (asked, least) in enumerate([(30, 2), (30, 3), (150, 3), (180, 5), (365, 6), (30, 8), (30, 9)])], [sales])
    comps, tiers = cascade.windowed(q.withColumn("held", F.lit(0)), a, F.lit(NOW), cascade.STORED, True)
    assert {r["query_id"]: r["reach"] for r in tiers.collect()} == {0: "30", 1: "180", 2: "150", 3: "365", 4: "365", 5: "all", 6: "all"}
    assert {r["query_id"]: r["n"] for r in comps.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 4, 2: 3, 3: 6, 4: 6, 5: 8, 6: 8}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_sums(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *range(9)]), r.choice([None, 0, r.randint(1, 50)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k int, n int")
    out = ranks.prefix_sums(df, ["k", "id"], F.col("n"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    total, want = 0, {}
    for place, (i, _, n) in enumerate(sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0])), 1):
        total += n or 0
        want[i] = (place, total)
    assert {x["id"]: (x["place"], x["total"]) for x in out.collect()} == want
    budget = total // 3
    assert {x["id"] for x in ranks.take_while(df, ["k", "id"], F.col("n"), budget).collect()} == {i for i, (_, t) in want.items() if t <= budget}
    assert ranks.prefix_sums(df.limit(0), ["k"], F.col("n")).collect() == []


def test_upper_medians(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.choice([None, *range(6)])) for _ in range(200)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v int")

    def upper(values):
        return sorted(values)[len(values) // 2]

    groups = {k: [v for g, v in rows if g == k and v is not None] for k in "abc"}
    assert {x["k"]: x["upper_median"] for x in ranks.upper_medians(df, ["k"], "v").collect()} == {k: upper(v) for k, v in groups.items()}
    assert ranks.upper_medians(df, [], "v").first()[0] == upper([v for _, v in rows if v is not None])


def test_quota_and_backlog(spark):
    df = spark.range(30).withColumn("urgent", F.col("id") % 7 == 0)
    got = sorted(x["id"] for x in ranks.mixed_quota(df, F.col("urgent"), ["id"], 10, 4).collect())
    assert got == sorted([0, 7, 14, 21, 28] + [1, 2, 3, 4, 5, 6, 8, 9, 10])
    sets = spark.createDataFrame([("morgan 1921-d", None, ["refresh"], "P0"), ("a b", "A/B: (x)", ["needs-data"], None), ("c", None, ["dormant"], "P0"), ("d", None, None, "P3")], "key string, search_term string, actions array<string>, priority string")
    files = spark.createDataFrame([("1921_D_Morgan.csv",), ("other.csv",)], "file string")
    got = sorted(map(tuple, ranks.backlog(sets, files, ["P0"]).collect()))
    assert got == [("a b", "AB_x.csv", True), ("morgan 1921-d", "1921_D_Morgan.csv", False)]


def test_pilots(spark):
    names = ["pilot_id", "run_id", "at", "state_before", "state_after", "requested", "effective", "duration", *pilot.COUNTS, "machine"]

    def run(p, i, tuned, **more):
        profile = pilot.TUNED if tuned else pilot.BASELINE
        row = {"pilot_id": p, "run_id": f"r{i:02d}", "at": i, "state_before": "Normal", "state_after": "Normal", "requested": profile, "effective": profile, "duration": 80.0 if tuned else 100.0, "attempted": 10, "succeeded": 9, "failed": 1, "empty": 0, "unknown": 0, "challenges": 0, "no_export": 0, "machine": "m"} | more
        return tuple(row[n] for n in names)

    good = list(enumerate(pilot.SEQUENCE))
    rows = [run("adopt", i, t) for i, t in good]
    rows += [run("slow", i, t, duration=99.0) for i, t in good]
    rows += [run("worse", i, t, succeeded=9 - t, failed=1 + t) for i, t in good]
    rows += [run("hard", i, t, challenges=int(i == 3)) for i, t in good]
    rows += [run("swapped", i, t if i not in (4, 5) else 1 - t) for i, t in good]
    rows += [run("short", i, t) for i, t in good[:9]]
    rows += [run("long", i, t) for i, t in good] + [run("long", 12, 0)]
    rows += [run("gap", i, t, state_before="Elevated" if i == 2 else "Normal") for i, t in good]
    rows += [run("sums", i, t, unknown=int(i == 11)) for i, t in good]
    rows += [run("mixed", i, t, machine="m" if i else None) for i, t in good]
    rows += [run("none", 0, 0, attempted=None)]
    got = {r["pilot_id"]: r for r in pilot.report(spark.createDataFrame(rows, "pilot_id string, run_id string, at int, state_before string, state_after string, requested string, effective string, duration double, " + ", ".join(f"{c} int" for c in pilot.COUNTS) + ", machine string"), "at", ["machine"]).collect()}
    assert {p: r["recommendation"] for p, r in got.items()} == {"adopt": "adopt", "slow": "retain-baseline", "worse": "retain-baseline", "hard": "reject"} | dict.fromkeys(["swapped", "short", "long", "gap", "sums", "mixed", "none"], "insufficient-data")
    assert {p: (r["passes"], r["problems"], r["surplus"], r["break_at"]) for p, r in got.items() if p in ("adopt", "swapped", "short", "long", "gap", "none")} == {"adopt": (12, 0, 0, None), "swapped": (12, 0, 0, 5), "short": (9, 0, 0, 10), "long": (12, 0, 1, None), "gap": (11, 1, 0, 3), "none": (0, 1, 0, 1)}
    assert got["adopt"]["faster_pct"] == 20.0 and got["mixed"]["mixed"]


def test_stores(spark):
    texts = [(2, '{"silver": {"t": {"1921": {"P": 101, "S": 50, "D": "no"}, "odd": {"P": 777}}}, "x": 5, "y": [1, {"a": 2}], "z": {"t": 1}}'), (1, '{"gold": {"t": {"1922": {"P": 101}, "1900": {"W": 202.0}}}}'), (3, "broken"), (4, None), (5, "[]")]
    df = spark.createDataFrame(texts, "nth int, text string")
    leaves = stores.walked(df, "text", ["category", "kind", "year", "mint"], "number")
    got = sorted((r["nth"], r["category"], r["kind"], r["year"], r["mint"], r["n"]) for r in leaves.select("nth", "category", "kind", "year", "mint", F.to_json("number").alias("n")).collect())
    assert got == [(1, "gold", "t", "1900", "W", "202"), (1, "gold", "t", "1922", "P", "101"), (2, "silver", "t", "1921", "D", '"no"'), (2, "silver", "t", "1921", "P", "101"), (2, "silver", "t", "1921", "S", "50"), (2, "silver", "t", "odd", "P", "777")]
    assert sorted(map(tuple, stores.catalogue(leaves).collect())) == [(101, "gold", 1922), (202, "gold", 1900)]
    assert stores.as_store(spark.createDataFrame([("k", None, None)], "key string, search_term string, comp_count int")).first()["comps"] == 0


def test_mint_marks_and_merged_sets(spark):
    q = spark.createDataFrame([(1, "1896-S Morgan dollar"), (2, "1896 Morgan dollar"), (3, "silver eagle")], "query_id int, term string")
    k = spark.createDataFrame([(10, "1896 Morgan dollar"), (11, "1896-O Morgan dollar"), (12, "1896-S Morgan dollar"), (20, "2020 silver eagle"), (21, "generic silver eagle"), (22, "2021 silver eagle proof")], "key_id int, term string")
    assert {r["query_id"]: r["key_id"] for r in resolve.resolve(q, k).collect()} == {1: 12, 2: 10, 3: 21}
    found = resolve.resolve_all(q, k)
    assert sorted((r["query_id"], r["key_id"], r["place"]) for r in found.collect()) == [(1, 12, 1), (2, 10, 1), (3, 20, 2), (3, 21, 1)]
    comps = spark.createDataFrame([(20, "t", 5.0, "a"), (21, "t", 5.0, "b"), (20, None, 6.0, "c"), (22, "u", 1.0, "d")], "key_id int, title string, price double, note string")
    got = sorted((r["query_id"], r["title"] or "", r["price"], r["key_id"], r["note"]) for r in resolve.merged_comps(found, comps, ["title", "price"]).collect())
    assert got == [(3, "", 6.0, 20, "c"), (3, "t", 5.0, 21, "b")]


def test_full_cohorts_stay_apart(spark, monkeypatch):
    """Queries of a cohort whose own year is full meet none of its sales (their pairs were written out before)."""
    sales = [(1000 + i, "raw", i, 1.0, 1, NOW, True, "x", 1990 + i % 3) for i in range(300)] + [(5000 + i, "raw", 900 + i, 2.0, 1, NOW, True, "y", 1990) for i in range(6)]
    queries = [(i, i, "raw", 90, 3, "x", 1991) for i in range(300)] + [(300, 300, "raw", 90, 3, "y", 1991), (301, 301, "proof", 90, 3, "y", 1991)]
    q, (a, none) = frames(spark, queries, [sales, []])
    written, plain = {}, cascade.staged

    def counting(df, name):
        out = plain(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(cascade, "staged", counting)
    comps, ways = cascade.cascade(q, a, none, none, F.lit(NOW))
    assert [(r["query_id"], r["route"]) for r in ways.collect()] == [(300, "neighbours")]
    assert comps.count() == 6 and max(written.values()) <= 306


def test_neighbours_are_summed_once(spark, tmp_path, monkeypatch):
    """100 parts of one cohort, year and pool take the same 300 sales: no row for each part and sale, and the SQL's result."""
    duck = duckdb.connect()
    duck.execute("""CREATE TABLE part AS SELECT range AS p_partkey, 'coin ' || range AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, 30 AS p_size, 900.0 + range AS p_retailprice FROM range(300)""")
    duck.execute("""CREATE TABLE lineitem AS SELECT i AS l_orderkey, i % 100 * 3 + 1 AS l_partkey, 1 AS l_linenumber, 2.0 AS l_quantity, 100.0 + i * i % 777 AS l_extendedprice, i % 8 / 100 AS l_discount, 0.01 AS l_tax, 'R' AS l_returnflag,
      TIMESTAMP '1995-02-01' + INTERVAL (i * 2) DAY AS l_shipdate FROM range(300) t(i)
      UNION ALL SELECT 1000 + i, i * 3, 1, 1.0, 50.0 + i, 0.02, 0.07, CASE WHEN i % 2 = 0 THEN 'N' END, TIMESTAMP '2001-01-01' FROM range(20) t(i)""")
    for name in ("part", "lineitem"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    seen, plain = [], cascade.priced
    monkeypatch.setattr(cascade, "priced", lambda items, found, ways: seen.append(found.count()) or plain(items, found, ways))
    rows = queries()["price_batch"](spark, str(tmp_path)).collect()
    assert seen[0] <= 300  # 30,010 before
    assert sorted(map(tuple, rows)) == sorted(duck.execute(oracle_sql()["price_batch"]).fetchall())
    assert {r["route"] for r in rows} == {"neighbours", "active", None} and sum(r["route"] == "active" for r in rows) == 20  # half of these have no flag


@pytest.mark.parametrize("seed", [5, 6])
def test_sums_are_those_of_the_comps(spark, seed):
    asked = [(i, i % 9, "raw" if i % 3 else "proof", (90, 180, 200, 365)[i % 4], (1, 3, 8, 25)[i % 4], "xy"[i % 2], (1988, 1991, None)[i % 3]) for i in range(40)]
    q, (a, b, c) = frames(spark, asked, [[x for x in listings(seed) if x[0] != 7], [x for x in listings(seed + 10, 60) if x[0] != 7], listings(seed + 20)])
    comps, ways = cascade.cascade(q, a, b, c, F.lit(NOW))
    stats, same = cascade.summed(q, a, b, c, F.lit(NOW))
    groups = {}
    for r in comps.collect():
        groups.setdefault(r["query_id"], []).append((r["price"], r["score"], float(r["sold"])))
    got = {r["query_id"]: r for r in stats.collect()}
    assert stats.count() == len(groups) and sorted(map(str, same.collect())) == sorted(map(str, ways.collect()))
    assert {r["route"] for r in ways.collect()} == {"stored", "neighbours", "searched", "active"}
    for k, rows in groups.items():
        price, score, sold = zip(*rows)
        r = got[k]
        assert (r["n"], r["sold_median"], r["sold_share"]) == (len(rows), statistics.median(price), sold[0])
        assert [r["sd"], r["_mean"], r["_score"]] == pytest.approx([statistics.stdev(price) if len(rows) > 1 else 0.0, statistics.fmean(price), statistics.fmean(score)])


def test_binned_median(spark):
    r = random.Random(7)
    groups = {"a": [r.uniform(-50, 5000) for _ in range(301)], "b": [r.uniform(0, 9) for _ in range(300)], "c": [3.25], "d": [1.0, 1000.0], "e": [-2.0, -2.0, 0.0, 0.0], "f": [0.5] * 7 + [4e9]}
    rows = [(k, v) for k, values in groups.items() for v in [*values, None]] + [("none", None), (None, 8.0)]
    r.shuffle(rows)
    got = {x["k"]: x["median"] for x in robust.binned_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: statistics.median(v) for k, v in groups.items()}


def test_equal_terms_are_looked_up_once(spark, monkeypatch):
    """300 searches of three terms meet the keys three times, and each has its answer."""
    q = spark.createDataFrame([(i, ["1964 kennedy half", "silver bar cast", None, "1881 morgan dollar"][i % 4]) for i in range(400)], "query_id int, term string")
    k = spark.createDataFrame([(1, "1964 kennedy half"), (2, "silver bar cast"), (3, "silver bar cast round")], "key_id int, term string")
    seen, plain = [], resolve.token_matches
    monkeypatch.setattr(resolve, "token_matches", lambda a, b, **how: seen.append(a.count()) or plain(a, b, **how))
    assert {r["query_id"]: r["key_id"] for r in resolve.resolve(q, k).collect()} == {i: i % 4 + 1 for i in range(400) if i % 4 < 2}
    assert {(r["query_id"], r["key_id"], r["place"]) for r in resolve.resolve_all(q, k).collect()} == {(i, n, p) for i in range(400) for n, p in {0: [(1, 1)], 1: [(2, 1), (3, 2)]}.get(i % 4, [])}
    assert seen == [3, 3]
