"""How far the word use of each source lies from that of the other sources and of its language.

Terms are cut from the texts' bytes: a table of 256 entries lower-cases and tells what is a
term's, over the concatenated UTF-8 buffer of a batch; slices are grouped by their XXH64 and
each is compared with its group's first, byte by byte. Counts go to Spark, which sums them.

A pair of sources sums a whole-number divergence over all kept terms of the language. Terms
that neither has are one product; terms that one has depend on their count alone, so they
come from the source's counts by value; only terms that both have are met one by one, in
compressed rows (a row a term) of a block of terms, summed by ``reduceat``. Blocks hold
about as many cells whatever share of them one language has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, written

#: Bytes of text that are cut at once.
BYTES = 1 << 23
#: Cells of a block of terms, on average at most; entries that a task works on at once.
CELLS, ENTRIES = 1 << 14, 1 << 20
#: Tasks that share the sources of one language.
SHARES = 16
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _table() -> np.ndarray:
    """A byte's lower case, 0 for ASCII bytes that are no letters."""
    codes = np.arange(256, dtype=np.uint8)
    upper = (codes >= 65) & (codes <= 90)
    term = upper | (codes >= 97) & (codes <= 122) | (codes >= 128)
    return np.where(term, np.where(upper, codes + 32, codes), 0).astype(np.uint8)


LOWER = _table()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(rows: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of each row of a byte matrix."""
    n, width = rows.shape
    if width >= 32:
        return np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in rows), np.uint64, n)
    h = np.full(n, P5 + np.uint64(width), np.uint64)
    at = 0
    while width - at >= 8:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()
        h = _rotated(h ^ (_rotated(lane * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if width - at >= 4:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
        h = _rotated(h ^ (lane * P1), 23) * P2 + P3
        at += 4
    for i in range(at, width):
        h = _rotated(h ^ (rows[:, i].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts; start, length and text number of each term."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    folded = LOWER[np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inner = folded != 0
    first, last = inner.copy(), inner.copy()
    if len(folded):
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        border = offsets[(offsets > 0) & (offsets < len(folded))]
        first[border] = inner[border]
        last[border - 1] = inner[border - 1]
    starts = np.flatnonzero(first)
    return folded, starts, np.flatnonzero(last) - starts + 1, np.searchsorted(offsets, starts, "right") - 1


def grouped(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashed: Callable[[np.ndarray], np.ndarray] = xxh64) -> tuple[np.ndarray, np.ndarray]:
    """Each slice's group, and the slice that stands for each group; one group has the same bytes.

    Slices that share a hash with others of other bytes are grouped again among themselves.
    """
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    by_length = [own for own in np.split(order, cuts) if len(own)]
    h = np.empty(len(starts), np.uint64)

    def rows(own: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(folded, int(lengths[own[0]]))[starts[own]]

    for own in by_length:
        h[own] = hashed(rows(own))
    group = np.empty(len(starts), np.int64)
    stands: list[np.ndarray] = []
    left = np.arange(len(starts))
    n = 0
    while len(left):
        _, first, number = np.unique(h[left], return_index=True, return_inverse=True)
        like = left[first[number]]
        same = lengths[left] == lengths[like]
        for width in np.unique(lengths[left[same]]):
            at = np.flatnonzero(same & (lengths[left] == width))
            same[at] = (rows(left[at]) == rows(like[at])).all(axis=1)
        group[left[same]] = n + number[same]
        stands.append(left[first])
        n += len(first)
        left = left[~same]
    return group, np.concatenate(stands) if stands else np.empty(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, count, docs`` of each batch; the empty term stands for the source itself."""
    for batch in small(batches, "text", BYTES):
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        numbers: dict[tuple[str, str], int] = {}
        of_text = np.array([numbers.setdefault(pair, len(numbers)) for pair in zip(langs, sources)], np.int64)
        folded, starts, lengths, text = slices(batch.column("text"))
        group, stands = grouped(folded, starts, lengths)
        most = len(stands) + 1
        cell, n = np.unique(text * most + group, return_counts=True)
        key, number = np.unique(of_text[cell // most] * most + cell % most, return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, number, n)
        docs = np.bincount(number, minlength=len(key))
        ends = np.cumsum(lengths[stands])
        spread = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[stands] - ends + lengths[stands], lengths[stands])
        terms = pa.Array.from_buffers(pa.large_binary(), len(stands), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(folded[spread])]).cast(pa.string())
        names = [pa.array([p[i] for p in numbers], pa.string()) for i in (0, 1)]
        own = pa.array(key // most)
        columns = [*(c.take(own) for c in names), terms.take(pa.array(key % most)), pa.array(count), pa.array(docs, pa.int64())]
        zero = pa.array(np.zeros(len(numbers), np.int64))
        marks = [*names, pa.array([""] * len(numbers), pa.string()), zero, zero]
        for part in (columns, marks):
            yield pa.RecordBatch.from_arrays(part, ["lang", "source", "term", "count", "docs"])


def shares(count: np.ndarray, size: np.ndarray | int, scale: int) -> np.ndarray:
    """``1 + floor(scale * (count + 1) / size)`` by long division: exact for sizes below 9 * 10**15."""
    rest, out = count + 1, np.zeros_like(count)
    while scale > 1:
        step = min(scale, 1000)
        out, rest = out * step + rest * step // size, rest * step % size
        scale //= step
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def share(count: Column, size: Column, scale: int) -> Column:
    """``shares`` as a column."""
    rest, out = count + 1, F.lit(0).cast("bigint")
    while scale > 1:
        step = min(scale, 1000)
        out, rest = out * step + F.call_function("div", rest * step, size), rest * step % size
        scale //= step
    return out + 1


def _names(table: pa.Table, column: str) -> tuple[np.ndarray, list[str]]:
    coded = table[column].combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _pairs(lang: str, source: list, item: list, value: list) -> pa.Table:
    n = [len(v) for v in value]
    return pa.table({"lang": pa.array([lang] * sum(n), pa.string()), "source": pa.array([s for own in source for s in own], pa.string()), "item": pa.array([s for own in item for s in own], pa.string()), "value": pa.array(np.concatenate([np.empty(0, np.int64), *value]), pa.int64())})


def _met(scale: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block of terms: for each pair of sources, what terms of both add to what each alone gives."""

    def run(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("term")
        source, names = _names(cells, "source")
        term, _ = _names(cells, "term")
        count, size = cells["count"].to_numpy(), cells["size"].to_numpy()
        p, zero = shares(count, size, scale), shares(np.zeros_like(count), size, scale)
        begins = np.flatnonzero(np.diff(term, prepend=-1))  # compressed rows: a term's cells stand together
        widths = np.diff(begins, append=len(term))
        sums: list[tuple[list, list, np.ndarray]] = []
        own = np.argsort(source, kind="stable")
        for mine in np.split(own, np.flatnonzero(np.diff(source[own])) + 1):
            name = names[source[mine[0]]]
            width = widths[term[mine]]
            for part in np.split(mine, np.flatnonzero(np.diff(np.cumsum(width) // ENTRIES)) + 1):
                n = widths[term[part]]
                a = np.repeat(part, n)
                b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[term[part]], n)
                a, b = a[a != b], b[a != b]
                if not len(a):
                    continue
                more = distance(p[a], p[b]) - distance(p[a], zero[b]) - distance(zero[a], p[b]) + distance(zero[a], zero[b])
                by = np.argsort(source[b], kind="stable")
                at = np.flatnonzero(np.diff(source[b][by], prepend=-1))
                sums.append(([name] * len(at), [names[i] for i in source[b][by][at]], np.add.reduceat(more[by], at)))
        return _pairs(cells["lang"][0].as_py(), *([list(x) for x in zip(*sums)] or [[], [], []]))

    return run


def _alone(scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of some sources: for each other source of the language, in both directions, the terms that it lacks."""

    def run(counts: pa.Table, sources: pa.Table) -> pa.Table:
        every, size, terms = sources["source"].to_pylist(), sources["size"].to_numpy(), sources["terms"].to_numpy()
        lang, known = sources["lang"][0].as_py(), int(sources["known"][0].as_py())
        zero = shares(np.zeros(len(every), np.int64), np.maximum(size, 1), scale)
        held: dict[str, list[tuple[int, int]]] = {}
        for r in counts.to_pylist():
            held.setdefault(r["source"], []).append((r["count"], r["terms"]))
        source, item, value = [], [], []
        for i in np.flatnonzero(sources["own"].to_numpy(zero_copy_only=False)).tolist():
            c = np.array(held.get(every[i], []), np.int64).reshape(-1, 2)
            p = shares(c[:, 0], max(int(size[i]), 1), scale)
            there = (known - terms[i]) * distance(zero[i], zero)
            back = -terms[i] * distance(zero, zero[i])
            step = max(1, ENTRIES // len(every))
            for a in range(0, len(c), step):
                n, own = c[a : a + step, 1, None], p[a : a + step, None]
                there = there + (n * distance(own, zero[None])).sum(axis=0)
                back = back + (n * distance(zero[None], own)).sum(axis=0)
            others = [s for j, s in enumerate(every) if j != i]
            source += [[every[i]] * len(others), others]
            item += [others, [every[i]] * len(others)]
            value += [np.delete(there, i), np.delete(back, i)]
        return _pairs(lang, source, item, value)

    return run


def divergences(docs: DataFrame, least: int = 3, top: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of each language of ``docs`` (text, lang, source).

    A language keeps the terms that at least ``least`` of its rows have. A term's share in a
    source is ``1 + floor(scale * (count + 1) / (all counts + kept terms))``, its divergence
    from a share q ``floor((p - q)**2 / q)``. Part ``pair`` has for each other source of the
    language the divergences summed over all kept terms; part ``term`` the ``top`` terms of
    the source whose share is above the language's. Ranks go by value, descending, then by
    the item's bytes.

    Nulls count as empty strings, which are a language or a source like others; a source
    without terms has pairs; a language without kept terms has pairs of value 0; repeated
    rows are as many documents. An empty table gives an empty result; other columns are not
    read. ``scale`` is a power of ten up to 10**9, a source has less than 9 * 10**15 terms.
    """
    raw = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = raw.mapInArrow(_count, "lang string, source string, term string, count bigint, docs bigint")
    cells = written(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-cells")
    across = Window.partitionBy("lang", "term")
    first = F.row_number().over(across.orderBy("source")) == 1
    kept = cells.where("term != ''").select("lang", "source", "term", "count", F.sum("docs").over(across).alias("docs"), F.sum("count").over(across).alias("total"), first.alias("first"))
    kept = written(kept.where(F.col("docs") >= least).drop("docs"), "term-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"), F.count_if("first").alias("firsts"))
    sums = cells.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["n", "terms", "firsts"])
    by_lang = sums.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("firsts").alias("known"))
    sources = written(sums.join(by_lang, "lang").select("lang", "source", "terms", "known", (F.col("n") + F.col("known")).alias("size"), (F.col("all") + F.col("known")).alias("lang_size")), "term-sources")

    sized = kept.join(sources.select("lang", "source", "size", "lang_size"), ["lang", "source"])
    p, q = share(F.col("count"), F.col("size"), scale), share(F.col("total"), F.col("lang_size"), scale)
    terms = sized.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    pair = "lang string, source string, item string, value bigint"
    blocks = -(-kept.count() // CELLS) or 1
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    met = sized.select("lang", "source", "term", "count", "size", block).groupBy("lang", "block").applyInArrow(_met(scale), pair)
    mine = F.pmod(F.xxhash64("source"), F.lit(SHARES))
    counts = kept.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")).withColumn("share", mine)
    copies = sources.select("lang", "source", "terms", "known", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("share"), mine.alias("mine"))
    copies = copies.withColumn("own", F.col("share") == F.col("mine")).drop("mine")
    alone = counts.groupBy("lang", "share").cogroup(copies.groupBy("lang", "share")).applyInArrow(_alone(scale), pair)
    pairs = met.union(alone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= top))
