"""Divergences of sources against plain dictionaries; hashes against the library."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hammerprice.llm import divergence
from hammerprice.llm.queries import op13_source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, count int, size string"  # the last three clash with names used inside
SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 7, "y") for i, r in enumerate(rows)], SCHEMA)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least, top, scale):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms(text)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []

    def ranked(lang, source, part, values, most):
        order = sorted(values.items(), key=lambda kv: (-kv[1], kv[0].encode()))
        out.extend((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order[:most]))

    for lang, seen in docs.items():
        kept = [t for t, n in seen.items() if n >= least]
        own = {s: c for (g, s), c in counts.items() if g == lang}

        def share(c):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + scale * (c[t] + 1) // size for t in kept}

        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            ranked(lang, s, "pair", {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in own if o != s}, None)
            ranked(lang, s, "term", {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if own[s][t] and p[s][t] > q[t]}, top)
    return sorted(out)


def check(spark, rows, least=3, top=200, scale=10**9):
    found = divergence.divergences(frame(spark, rows), least, top, scale).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == brute(rows, least, top, scale)


def odd_rows(seed, n=150):
    r = random.Random(seed)
    words = ["The", "the", "a", "Été", "ÉTÉ", "naïve", "x1y", "zz-top", "日本", "İ", "w" * 40, "w" * 33 + "é", "don't", "\x00nul\x7fdel"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "fr", None]), r.choice(["a", "a", "a", "b", "c", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "none"), ("", "xx", "p"), ("12 34", "xx", "q"), ("once", "yy", "r"), ("the " * 5000, "en", "long")] + [("same text", "zz", "s")] * 4


@pytest.mark.parametrize("seed,least,top,scale", [(1, 3, 200, 10**9), (2, 1, 3, 10**4), (3, 2, 1, 10**9)])
def test_against_dictionaries(spark, seed, least, top, scale):
    check(spark, odd_rows(seed), least, top, scale)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 7)
    check(spark, odd_rows(4))


def test_documents(spark):
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(rows, 3, 200, 10**9)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in op13_source_divergence(spark, SMALL).collect()) == want


def test_empty_table(spark):
    assert divergence.divergences(frame(spark, [])).collect() == []


@pytest.mark.parametrize("width", [1, 3, 4, 7, 8, 11, 12, 16, 21, 28, 31, 32, 50])
def test_hash(width):
    rows = np.random.default_rng(width).integers(0, 256, (20, width), dtype=np.uint8)
    assert divergence.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def test_slices_of_a_sliced_array():
    texts = pa.array(["skip me", None, "Ab", "cD", "", "é-É"])[1:]
    folded, starts, lengths, text = divergence.slices(texts)
    assert [(bytes(folded[s : s + n]).decode(), t) for s, n, t in zip(starts, lengths, text)] == [("ab", 1), ("cd", 2), ("é", 4), ("É", 4)]


@pytest.mark.parametrize("hashed", [divergence.xxh64, lambda rows: rows[:, 0].astype(np.uint64) % 3, lambda rows: np.zeros(len(rows), np.uint64)])
def test_equal_hashes_of_different_bytes_are_told_apart(hashed):
    folded, starts, lengths, _ = divergence.slices(pa.array(["a b a ab abc ab b", "abc c ca a", "ca " * 5]))
    group, stands = divergence.grouped(folded, starts, lengths, hashed)
    words = [bytes(folded[s : s + n]) for s, n in zip(starts, lengths)]
    assert len(stands) == len(set(words)) and all(words[i] == words[stands[g]] for i, g in enumerate(group))


def test_shares_are_exact():
    r = np.random.default_rng(1)
    size = r.integers(1, 9 * 10**15, 500)
    count = (size * r.random(500)).astype(np.int64) - 1
    assert divergence.shares(count, size, 10**9).tolist() == [1 + 10**9 * (int(c) + 1) // int(s) for c, s in zip(count, size)]


def test_pieces_of_a_block_sum_to_the_same(monkeypatch):
    r = random.Random(5)
    cells = {(f"t{r.randrange(30)}", f"s{r.randrange(8)}") for _ in range(120)}
    table = pa.table({"lang": ["en"] * len(cells), "source": [s for _, s in cells], "term": [t for t, _ in cells], "count": [r.randint(1, 90) for _ in cells], "size": [900] * len(cells), "block": [0] * len(cells)})

    def sums():
        out = Counter()
        for row in divergence._met(10**9)(table).to_pylist():
            out[row["source"], row["item"]] += row["value"]
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert sums() == whole and len(whole) > 30
