"""Sources, sinks and streams on small files."""

import datetime as dt
import json

import pytest

from hammerprice import streaming
from hammerprice.sources import listings, sinks

CSV = '''﻿Item Title,Item ID,Sold Date,Sold Price,Shipping,Condition,Quantity Sold,Odd
"1921 Morgan, Silver Dollar",11,"Jan 5, 2024","$1,020.50",4.5,Certified,1,x
,12,2024-01-06,30,,Uncirculated,0,x
[Removed] Item 3,13,2024-01-06,30,0,,1,x
2020 Silver Eagle replica,14,2024-01-06,30,0,,1,x
2019 Gold Eagle,15,never,0,0,,2,x
2018 Gold Eagle roll,16,2024-01-08,9,1,,2,x
'''


def test_listings(spark, tmp_path):
    (tmp_path / "Morgan_Dollar.csv").write_text(CSV)
    (tmp_path / "Morgan_Dollar.meta").write_text("morgan silver dollar")
    rows = listings.listings(spark, f"{tmp_path}/*.csv")
    got = {r["price"]: r for r in rows.collect()}
    assert sorted(got) == [9.0, 30.0, 1020.5]
    assert got[1020.5]["total_usd"] == 1025.0 and got[1020.5]["pool"] == "graded" and got[1020.5]["sold_date"].date() == dt.date(2024, 1, 5)
    assert got[30.0]["title"].startswith("1921 Morgan") and got[30.0]["item_id"] is None and got[30.0]["quantity_sold"] is None
    term = listings.search_terms(spark, f"{tmp_path}/*.meta", rows.select("_file").distinct())
    assert [r["term"] for r in term.collect()] == ["morgan silver dollar"]
    assert listings.unmapped(listings.read_csv(spark, f"{tmp_path}/*.csv")) == ["Odd"]


def test_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Item Title,Sold Price\n")
    assert listings.listings(spark, f"{tmp_path}/*.csv").count() == 0


def test_bulk_lines(spark):
    lines = spark.createDataFrame([("# note",), ("1921 Morgan | qty=5 | Grade=MS-63",), ("",), ("Eagle|weight=x|qty=no",)], "value string")
    assert [(r["query"], r["qty"], r["grade"], r["weight"]) for r in listings.bulk_lines(lines).collect()] == [("1921 Morgan", 5, "MS-63", None), ("Eagle", 1, None, None)]


def test_log_sessions(spark):
    text = ["start", "[ 10%] morgan ...", "OK (5 new, 2 dups)", "[ 20%] eagle ... WARNING: No data rows", "[ 30%] lost ..."]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)], "_file string, _row int, value string")
    got = sorted((r["n"], r["term"], r["new"], r["duplicates"], r["status"]) for r in listings.sessions(lines).collect())
    assert got == [(1, "morgan", 5, 2, "ok"), (2, "eagle", None, None, "no-data"), (3, "lost", None, None, "unknown")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"run_id": "a", "n": 1}) + "\nbroken\n" + json.dumps({"n": 2}) + "\n")
    got = [r["problems"] for r in listings.json_lines(spark, str(tmp_path), "run_id string, n int", ["run_id"]).collect()]
    assert got == [[], ["corrupt", "missing run_id"], ["missing run_id"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    with pytest.raises(sinks.ShrinkError):
        sinks.replace_guarded(df.limit(1), path, 2)
    fresh = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    sinks.append_new(fresh, path, ["k"], spark)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("gold", t, 1.0, True), ("gold", t + dt.timedelta(hours=1), 2.0, False), ("gold", t + dt.timedelta(days=1), 3.0, False), ("silver", t, 4.0, False)]
    spark.createDataFrame(rows, "metal string, ts timestamp, price double, ok boolean").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("metal string, ts timestamp, price double, ok boolean").parquet(str(src))
    first = streaming.collected(streaming.first_per_day(stream, ["metal"], "ts"), "firsts", "append", str(tmp_path / "c1"))
    assert first.count() == 3
