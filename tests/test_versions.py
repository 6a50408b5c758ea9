"""Versioned merges, the file ledger, guarded writers and ordered stream states."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from hammerprice import streaming
from hammerprice.sources import ledger, sinks
from hammerprice.sources.versions import ConflictError, ShrinkError, Store

SCHEMA = "k int, v string, w int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_and_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["k"], buckets=4)
    assert s.version() is None
    assert s.upsert(spark.createDataFrame([(i, "a", i) for i in range(20)], SCHEMA)) == 1
    before = s.version()
    assert s.upsert(spark.createDataFrame([(3, None, 99), (50, "new", None)], SCHEMA)) == 2
    want = {i: (i, "a", 99 if i == 3 else i) for i in range(20)} | {50: (50, "new", None)}
    assert {r[0]: r for r in rows(s.read())} == want and len(rows(s.read(1))) == 20
    after = s.version()
    assert sum(before.buckets[b] == after.buckets[b] for b in before.buckets) >= 2  # untouched buckets keep their folders
    s.delete(spark.createDataFrame([(3,), (777,)], "k int"))
    assert len(s.read().collect()) == 20 and len(s.read(2).collect()) == 21
    s.expire(1)
    assert s.numbers() == [3] and len(s.read().collect()) == 20


def test_refused_merge_changes_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["k"], buckets=2)
    s.upsert(spark.createDataFrame([(i, "a", i) for i in range(10)], SCHEMA))
    files = sorted(os.listdir(tmp_path / "data"))
    with pytest.raises(ShrinkError):
        s.merge(spark.createDataFrame([(1, "x", 1)], SCHEMA), lambda current, new: new)
    assert s.numbers() == [1] and sorted(os.listdir(tmp_path / "data")) == files and len(s.read().collect()) == 10


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path), ["k"], buckets=2) for _ in range(2))
    one.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    merged = Store._merged

    def slow(self, *args):
        out = merged(self, *args)
        if self is one and one.numbers() == [1]:  # the other comes in between
            two.upsert(spark.createDataFrame([(2, "two", 0)], SCHEMA))
        return out

    monkeypatch.setattr(Store, "_merged", slow)
    assert one.upsert(spark.createDataFrame([(3, "one", 0)], SCHEMA)) == 3
    assert [r[0] for r in rows(one.read())] == [1, 2, 3]

    def slower(self, *args):
        out = merged(self, *args)
        if self is one:
            two.upsert(spark.createDataFrame([(9, "two", self.version().number)], SCHEMA))
        return out

    monkeypatch.setattr(Store, "_merged", slower)
    with pytest.raises(ConflictError):
        one.upsert(spark.createDataFrame([(4, "late", 0)], SCHEMA))
    assert [r[0] for r in rows(one.read())] == [1, 2, 3, 9]


def test_null_keys_and_empty_merges(spark, tmp_path):
    s = Store(spark, str(tmp_path), ["k"], buckets=3)
    s.upsert(spark.createDataFrame([], SCHEMA))
    assert s.read().collect() == []
    s.upsert(spark.createDataFrame([(None, "a", 1)], SCHEMA))
    s.upsert(spark.createDataFrame([(None, None, 2)], SCHEMA))
    assert rows(s.read()) == [(None, "a", 2)]


def test_stream_batches_once(spark, tmp_path):
    src = str(tmp_path / "in")
    s = Store(spark, str(tmp_path / "t"), ["k"], buckets=2)
    for i in range(3):
        spark.createDataFrame([(i, "a", i), (0, "b", 10 + i)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        last = s.absorb(stream, "feed", str(tmp_path / "c"), lambda b: b.groupBy("k").agg(F.max_by("v", "w").alias("v"), F.max("w").alias("w"))).trigger(availableNow=True).start()
        last.awaitTermination()
    assert rows(s.read()) == [(0, "b", 12), (1, "a", 1), (2, "a", 2)]
    n = s.version().number
    assert s.upsert(spark.createDataFrame([(7, "again", 7)], SCHEMA), stream="feed", batch=0) == n  # a batch that is there already


def csv(path, n, title="1921 Morgan Dollar"):
    path.write_text("Title,Item ID,Sold Date,Sold Price\n" + "".join(f"{title} no {i},{i},2024-01-{i % 28 + 1:02d},{10 + i}\n" for i in range(n)))


def test_ledger(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store, book = Store(spark, str(tmp_path / "rows"), ["_file"], 4), Store(spark, str(tmp_path / "book"), ["path"], 2)
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    for name, n in (("same.csv", 60), ("less.csv", 200), ("more.csv", 200), ("gone file.csv", 5), ("none.csv", 0)):
        csv(folder / name, n)
    (folder / "notes.md").write_text("no listing")

    def touched(name, at):
        os.utime(folder / name, (at.timestamp(), at.timestamp()))

    def run(at, **more):
        found = ledger.import_folder(spark, str(folder), store, book, at, **more)
        return {os.path.basename(r["path"]).replace("%20", " "): r["action"] for r in found.collect()}

    for name in os.listdir(folder):
        touched(name, start - dt.timedelta(days=1))
    assert set(run(start).values()) == {"new"}
    entry = {os.path.basename(r["path"]).replace("%20", " "): r for r in book.read().collect()}
    assert {n: r["rows"] for n, r in entry.items()} == {"same.csv": 60, "less.csv": 200, "more.csv": 200, "gone file.csv": 5, "none.csv": 0}
    assert entry["same.csv"]["deep_at"] is not None and entry["gone file.csv"]["deep_at"] is None and entry["none.csv"]["page1_at"] is None
    assert entry["same.csv"]["first_sold"].day == 1 and entry["same.csv"]["last_sold"].day == 28
    size = {n: os.path.getsize(folder / n) for n in ("less.csv", "more.csv")}
    versions = store.version().number
    assert set(run(start + dt.timedelta(days=1)).values()) == {"fresh"} and store.version().number == versions
    for name, share in (("less.csv", 1.09), ("more.csv", 1.11)):  # longer, but with the old time
        with (folder / name).open("a") as f:
            while f.tell() + 40 < size[name] * share:
                f.write("2020 Silver Eagle,,2024-02-01,50\n")
        touched(name, start - dt.timedelta(days=1))
    (folder / "gone file.csv").unlink()
    got = run(start + dt.timedelta(days=2))
    assert got == {"same.csv": "fresh", "less.csv": "fresh", "more.csv": "grown", "gone file.csv": "vanished", "none.csv": "fresh"}
    counts = {os.path.basename(r["_file"]): r["n"] for r in store.read().groupBy("_file").agg(F.count("*").alias("n")).collect()}
    assert counts["same.csv"] == 60 and counts["less.csv"] == 200 and counts["more.csv"] > 200 and counts["gone file.csv"] == 5
    touched("less.csv", start + dt.timedelta(days=3))
    assert run(start + dt.timedelta(days=4))["less.csv"] == "modified"
    assert run(start + dt.timedelta(days=9), only=["same.csv"]) == {"same.csv": "stale"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA)
    path = str(tmp_path / "t")
    df.write.parquet(path)
    with pytest.raises(ShrinkError):
        sinks.replace_guarded(df.limit(1), path, 2)
    assert os.listdir(tmp_path) == ["t"]
    new = sinks.replace_guarded(df, path, 2, newest_first="w")
    assert [r["w"] for r in spark.read.parquet(new).collect()] == [2, 1]
    fresh = sinks.append_new(spark.createDataFrame([(2, "x", 9), (3, "d", 1), (3, "c", 2)], SCHEMA), path, ["k"], spark)
    assert rows(fresh) == [(3, "c", 2)] and rows(spark.read.parquet(path)) == [(1, "a", 1), (2, "b", 2), (3, "c", 2)]
    audit = str(tmp_path / "audit")
    days = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 5, 1))], "q string, computed_at timestamp")
    sinks.append_audit(days, audit, "computed_at")
    assert sinks.drop_days(spark, audit, dt.date(2024, 5, 2)) == ["2024-01-01"]
    assert [r["q"] for r in spark.read.parquet(audit).collect()] == ["b"]
    back = sinks.from_json(sinks.as_json(df).union(spark.createDataFrame([("{broken",)], "value string")), SCHEMA)
    assert rows(back) == rows(df)


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_states(spark, tmp_path, seed):
    """Any order and any batches give what a sorted table gives; a state goes after its time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "who string, at timestamp, hard int, soft int"
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    passes = [(who, start + dt.timedelta(minutes=i * 7 + n), r.choice([0, 0, 0, 0, 1]), r.choice([0, 0, 1, 3, None])) for n, who in enumerate("abc") for i in range(25)]
    end = [("zz", start + dt.timedelta(days=3), 0, 0)]
    last = [("zz", start + dt.timedelta(days=3, hours=1), 0, 0)]  # a watermark acts on the batch after its own
    r.shuffle(passes)
    cuts = sorted(r.sample(range(75), 3))
    src = str(tmp_path / "in")
    for i, part in enumerate([*(passes[a:b] for a, b in zip([0, *cuts], [*cuts, 75])), end, last]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{src}/*")
    name = f"ordered{seed}"
    got = streaming.collected(streaming.risk_stream(stream, "who", "at", "hard", "soft", "1 day"), name, "append", str(tmp_path / "c"))
    found = sorted((x["who"], x["at"], x["state"], x["reason"]) for x in got.where("who <> 'zz'").collect())
    want = streaming.risk_states(spark.createDataFrame(passes, schema), "who", "at", "hard", "soft")
    assert found == sorted((x["who"], x["at"], x["state"], x["reason"]) for x in want.collect())


def test_states_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "who string, at timestamp, hard int, soft int"
    day = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    steps = [("a", 0, 1), ("b", 0, 1), ("b", 4, 0), ("z", 9, 0), ("z", 10, 0), ("a", 20, 0), ("b", 20, 0), ("z", 30, 0), ("z", 31, 0)]
    for i, (who, n, hard) in enumerate(steps):
        spark.createDataFrame([(who, day + dt.timedelta(days=n), hard, 0)], schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = streaming.collected(streaming.risk_stream(stream, "who", "at", "hard", "soft", "1 day", "6 days"), "expiring", "append", str(tmp_path / "c"))
    states = {(x["who"], (x["at"] - day).days): x["state"] for x in got.where("who <> 'z'").collect()}
    assert states[("a", 0)] == "Cooldown" and states[("b", 4)] == "Cooldown" and states[("a", 20)] == "Normal" and states[("b", 20)] == "Normal"
