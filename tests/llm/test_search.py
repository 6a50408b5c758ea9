"""Candidate searches: what they may leave out, what they hold in memory, and how much they find."""

import pickle

import numpy as np
import pytest

from hammerprice.llm import decontaminate, simhash


def windows(block):
    return [tuple(block.words[a : a + block.size[i]].tolist()) for a, i in zip(block.start.tolist(), block.item.tolist())]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slots", [1 << 4, 1 << 23])
def test_suffixes_left_out_do_not_occur(monkeypatch, seed, slots):
    """Whatever collides in the bitmap, occurrences are those of a plain scan."""
    monkeypatch.setattr(decontaminate, "PAIR_BITS", slots)
    monkeypatch.setattr(decontaminate, "SEARCHED", 7)
    r = np.random.default_rng(seed)
    items = [(str(k), [b"w%d" % x for x in r.integers(0, 5, r.integers(0, 9))]) for k in range(40)]
    block = decontaminate.TestBlock(items, 4)
    ids = r.integers(-1, len(block.ids), 300)
    want = sorted((p, k) for k, w in enumerate(windows(block)) for p in range(len(ids) - len(w) + 1) if tuple(ids[p : p + len(w)].tolist()) == w)
    got = sorted(zip(*(x.tolist() for x in block.matches(ids))))
    assert got == want
    assert [w for _, w in items if w][0][:4] == [next(b for b, i in block.ids.items() if i == x) for x in windows(block)[0]]


def test_a_full_block_is_small():
    """Sixteen megabytes of items are less than four times as much for a worker."""
    r = np.random.default_rng(1)
    vocabulary = [b"%x" % x for x in r.integers(1 << 12, 1 << 28, 120_000)]
    texts = [[vocabulary[x] for x in (r.zipf(1.3, 2_000) % len(vocabulary)).tolist()] for _ in range(1_200)]
    size = sum(len(w) + 1 for t in texts for w in t)
    block = decontaminate.TestBlock(((str(k), t) for k, t in enumerate(texts)), 10)
    assert size > 1 << 24 and len(block.start) > 2_000_000
    assert len(pickle.dumps(block, 5)) < 4 * size
    ids = np.concatenate([[block.ids[w] for w in texts[7][100:130]], [-1], np.full(500, len(block.ids) - 1)])
    places, tests = block.matches(ids)
    assert {p for p, k in zip(places.tolist(), tests.tolist()) if block.item[k] == 7} >= set(range(21))


@pytest.mark.parametrize("shared, only", [((80, 10, 10), 0.8), ((80, 20, 0), 0.8), ((85, 15, 0), 0.85), ((90, 5, 5), 0.9), ((240, 30, 30), 0.8), ((16, 2, 2), 0.8)])
def test_recall_of_similar_texts(spark, shared, only):
    """Of 500 pairs of exactly that similarity nine in ten are found at least, and no others."""
    r = np.random.default_rng(3)
    both, a, b = shared
    rows, fresh = [], iter(r.permutation(2_000_000).tolist())

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    for k in range(500):
        common = words(both + 4)
        rows += [(2 * k, " ".join(common + words(a))), (2 * k + 1, " ".join(words(b) + common))]
    x, y = (set(simhash.shingles(t.encode())) for _, t in rows[:2])
    assert len(x & y) / len(x | y) == pytest.approx(only)
    found = {d["doc_id"]: d["component_id"] for d in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(c in (d, d - 1) for d, c in found.items())
    assert sum(found[2 * k + 1] == 2 * k for k in range(500)) >= 450


def family(size, words=200, changed=2):
    r = np.random.default_rng(5)
    rows = []
    for i in range(size):
        x = [f"w{k}" for k in range(words)]
        for at in r.choice(words, changed, replace=False):
            x[at] = f"new{i}"
        rows.append((i, " ".join(x)))
    return rows


def test_a_group_of_similar_texts_gives_no_pairs(spark, monkeypatch):
    """What is handed on of a group grows with its texts, not with their pairs."""
    counts, real = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: counts.append(links.count()) or real(links))
    rows = family(150)
    found = simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {d["component_id"] for d in found} == {0} and len(found) == len(rows)
    assert counts and max(counts) < 2 * len(rows)


@pytest.mark.parametrize("texts, shingles", [(10, 1 << 22), (1 << 12, 1_000)])
def test_large_blocks_lose_no_text(spark, monkeypatch, texts, shingles):
    rows = family(40) + [(100 + i, t.replace("w", "v")) for i, t in family(30, changed=9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, simhash.similar(docs).collect()))
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    assert sorted(map(tuple, simhash.similar(docs).collect())) == want
    assert len({c for d, c in want if d < 100}) == 1 and len({c for d, c in want if d >= 100}) > 5
