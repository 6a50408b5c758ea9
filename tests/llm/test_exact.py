"""Exact dedup against a dictionary of texts; the codes against round trips."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hammerprice.llm import exact
from hammerprice.llm.queries import op11_exact_dedup

SCHEMA = "doc_id bigint, text string, keep_id string, sender int, row string"  # the last three clash with names used inside
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], SCHEMA)


def brute(rows):
    """doc_id, keep_id, group_size, sha of every row, sorted; and the ids that stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).digest() for t in groups}
    return sorted(((i, top[t or ""], len(groups[t or ""]), sha[t or ""]) for i, t in rows), key=str), sorted(map(str, top.values()))


def check(spark, rows):
    found = exact.duplicates(frame(spark, rows)).collect()
    want, kept = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["sha"])) for r in found), key=str) == want
    assert sorted(str(r["doc_id"]) for r in found if r["kept"]) == kept
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def odd_rows():
    r = random.Random(3)
    long = "".join(r.choice("abc d") for _ in range(200_000))
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, long), (8, long), (9, long + "x"), (None, "a"), (None, "z"), (None, "z"), (10, "é"), (11, "é")]
    rows += [(20, "twice"), (20, "twice"), (20, "other")]
    return rows + [(100 + i, r.choice(["hot"] * 30 + [str(r.randrange(40)) for _ in range(60)])) for i in range(900)]


@pytest.mark.parametrize("spare,places,owned", [(10, 20, 1 << 22), (-9, 3, 16), (0, 20, 1)])
def test_duplicates(spark, monkeypatch, spare, places, owned):
    """Also with fingerprints so short that most rows are suspected, eight rows a sender, many owners."""
    monkeypatch.setattr(exact, "SPARE", spare)
    monkeypatch.setattr(exact, "PLACES", places)
    monkeypatch.setattr(exact, "OWNED", owned)
    check(spark, odd_rows())


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(spark, rows)
    assert op11_exact_dedup(spark, SMALL).count() == len(rows)


def test_deduplicated_keeps_columns(spark):
    rows = odd_rows()
    found = exact.deduplicated(frame(spark, rows))
    assert found.schema.simpleString() == frame(spark, []).schema.simpleString()
    got = found.collect()
    assert sorted(str(r["doc_id"]) for r in got) == brute(rows)[1]
    assert {(r["keep_id"], r["sender"], r["row"]) for r in got} == {("x", 7, "y")}


def test_normalised(spark):
    found = exact.duplicates(frame(spark, [(1, "A b"), (2, "a B"), (3, "c")]), F.lower).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_empty_and_one_row(spark):
    assert exact.duplicates(frame(spark, [])).collect() == []
    assert exact.deduplicated(frame(spark, [])).collect() == []
    check(spark, [(None, None)])
    check(spark, [(1, "a")] * 50)


def test_texts_do_not_move(spark):
    """Only suspects' texts are shuffled: the bitmaps meet the texts in place."""
    staged = exact._Staged(frame(spark, odd_rows()).select("doc_id", "text"), exact._same, whole=False)
    plan = staged.judged()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.mark.parametrize("seed", range(6))
def test_golomb_round_trip(seed):
    r = np.random.default_rng(seed)
    width = int(r.integers(1, 1 << int(r.integers(1, 50))) + 1)
    values = np.unique(r.integers(0, width, int(r.integers(1, 3000))))
    k, unary, rest = exact.golomb(values, width)
    assert exact.ungolomb(len(values), k, unary, rest).tolist() == values.tolist()
    assert len(unary) + len(rest) <= len(values) * (max(0, np.log2(width / len(values))) + 3) / 8 + 2
