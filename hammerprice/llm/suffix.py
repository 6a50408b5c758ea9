"""Suffix-array dedup: bytes covered by a string that occurs anywhere else.

The corpus is cut into shards by anchored runs (see ``anchors``): equal strings lie
in runs of one anchor, hence in one shard, so shards need no comparison with each
other. Runs of equal context fall together first. A shard with several contexts gets
a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai); a window
with a neighbour that shares its whole length occurs elsewhere. An anchor with more
contexts than one array should hold is spread over many tasks instead, and its
windows are merged across shards by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling, index, met_by, mixed, shared_contexts, with_texts
from .shared import fields, utf8, written

#: Bytes of an anchor.
GRAM = 240
#: An anchor with more contexts is merged across shards.
CROWD = 1_000
#: Symbols of one suffix array, unless a single anchor has more.
ARRAY = 1 << 19
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_values(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, np.uint8)]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of whole numbers ``s`` (>= 0), and each suffix's rank.

    Larsson-Sadakane: suffixes sorted by their first h symbols are told apart by the
    ranks of the suffixes h further on; only groups that are still tied are sorted
    again, and h doubles."""
    n = len(s)
    bits = max(1, int(s.max() + 1).bit_length()) if n else 1
    h = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate((s.astype(np.int64) + 1, np.zeros(h, np.int64)))
    bits = max(bits, int(padded.max()).bit_length()) if n else bits
    h = max(1, 62 // bits)
    for i in range(h):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    tied = np.arange(n)  # places in the order whose suffix is tied with another

    def refine(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks (last place of the group) of sorted places; gives back those still tied."""
        end = np.ones(len(places), bool)
        end[:-1] = keys[1:] != keys[:-1]
        last = np.flatnonzero(end)
        size = np.diff(np.concatenate(([-1], last)))
        rank[order[places]] = np.repeat(places[last], size)
        return places[np.repeat(size > 1, size)]

    tied = refine(tied, key[order]) if n else tied
    while len(tied):
        suffix = order[tied]
        after = suffix + h
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[suffix] * (n + 1) + beyond
        by = np.argsort(keys)
        order[tied] = suffix[by]
        tied = refine(tied, keys[by])
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """Kasai: symbols, up to ``most``, that each suffix shares with the one sorted before it.

    The bound "one less than the suffix to the left" is carried along stretches of
    ``stride`` suffixes, all stretches side by side."""
    n = len(s)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    before = np.where(rank > 0, order[rank - 1], -1)
    end = np.concatenate((s, np.full(most + 1, -1, s.dtype)))
    starts = np.arange(0, n, stride)
    known = np.zeros(len(starts), np.int64)
    for step in range(stride):
        at = starts + step
        live = at < n
        at, known = at[live], known[live]
        starts = starts[live]
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0))
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            i, j = at[open_] + known[open_], other[open_] + known[open_]
            same = (end[i] == end[j]) & (end[i] >= 0) & (known[open_] < most)
            open_ = open_[same]
            known[open_] += 1
        shared[at] = known
    return shared


def repeated(texts: list[bytes], windows: list[int], width: int) -> list[np.ndarray]:
    """For each text its first ``windows`` windows: whether they occur among the others' (or its own) too."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    s = np.empty(int(sizes.sum()), np.int64)
    for k, (a, t) in enumerate(zip(starts.tolist(), texts)):
        s[a : a + len(t)] = np.frombuffer(t, np.uint8)
        s[a + len(t)] = 256 + k  # ends differ, so that no match runs on
    order, rank = suffix_array(s)
    with_before = common_prefixes(s, order, rank, width) >= width
    with_after = np.zeros(len(s), bool)
    with_after[order[:-1]] = with_before[order[1:]]
    both = with_before | with_after
    return [both[a : a + n] for a, n in zip(starts.tolist(), windows)]


def _stretches(at: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return at + edge[::2], edge[1::2] - edge[::2]


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """anchor, doc, at, n, lone, crowd, bytes: the contexts of the runs found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(c).to_pylist() for c in ("doc", "t"))
            for d, (text, found) in enumerate(zip(utf8(batch.column("text")), batch.column("found"))):
                anchor, ats, ns, lone, crowd = fields(found, "anchor", "at", "n", "lone", "crowd")
                at, n = ats.to_pylist(), ns.to_pylist()
                parts = pa.array([text[a : a + k - 1 + width] for a, k in zip(at, n)], pa.binary())
                place = pa.array([t[d] << 32 | a for a in at], pa.int64())
                yield pa.RecordBatch.from_arrays([anchor, pa.array([doc[d]] * len(at), pa.int64()), place, ns, lone, crowd, parts], ["anchor", "doc", "at", "n", "lone", "crowd", "bytes"])

    return rows.where("found is not null").select("doc", "t", "text", "found").mapInArrow(run, "anchor bigint, doc bigint, at bigint, n int, lone boolean, crowd boolean, bytes binary")


def _by_arrays(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated windows of lone contexts, by a suffix array for the anchors of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bool, bytes]] = []
        size = 0

        def solve() -> pa.RecordBatch:
            docs, ats, ns = [], [], []
            flags = repeated([r[5] for r in held], [r[3] for r in held], width)
            for (_, doc, at, _, lone, _), own in zip(held, flags):
                if lone and own.any():
                    start, n = _stretches(at, own)
                    docs += [doc] * len(start)
                    ats += start.tolist()
                    ns += n.tolist()
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int64()), pa.array(ns, pa.int32())], ["doc", "at", "n"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "at", "n", "lone", "bytes"))):
                if size > ARRAY and row[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                if held and held[-1][:3] == row[:3]:
                    continue  # of a repeated row
                held.append(row)
                size += len(row[5])
        if held:
            yield solve()

    shards = contexts.repartition("anchor").sortWithinPartitions("anchor", "doc", "at")
    return shards.mapInArrow(run, "doc bigint, at bigint, n int")


def _by_hashes(contexts: DataFrame, width: int) -> DataFrame:
    """The same for crowded anchors, window by window and without gathering an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, doc, at, n, lone, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "at", "n", "lone", "bytes"))):
                start = np.arange(n)
                hashes = Rolling(byte_values(text))(start, start + width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(hashes.view(np.int64)), pa.array(np.full(n, doc)), pa.array(at + start), pa.array(np.full(n, lone))], ["anchor", "hash", "doc", "at", "lone"])

    spread = contexts.select("anchor", "doc", "at", "n", "lone", "bytes").repartition("doc", "at")  # evenly, whatever their anchors
    windows = written(spread.mapInArrow(run, "anchor bigint, hash bigint, doc bigint, at bigint, lone boolean"), "crowd")
    place = F.struct("doc", "at")
    window = ["anchor", "hash"]  # the anchor's bytes and all bytes: 128 bits
    often = windows.groupBy(*window).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.sum(F.col("lone").cast("int")).alias("times")).where("first != last and times > 0")
    often = written(often.select(*window, "times"), "crowd-often")
    return met_by(windows.where("lone"), often, window).select("doc", "at", F.lit(1).alias("n"))


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """Runs of windows that occur elsewhere: doc, at, n."""
    met, contexts = shared_contexts(index(docs, byte_values, width, GRAM, "bytes"), "bytes")
    contexts = written(contexts, "contexts")
    inside = met_by(met, contexts.where("again").select("anchor", "context", "times"), ["anchor", "context"]).select("doc", "at", "n")
    several = contexts.where("contexts > 1").select("anchor", "first.doc", "first.at", "n", (~F.col("again")).alias("lone"), (F.col("contexts") > CROWD).alias("crowd"))
    cut = written(_cut(with_texts(docs, several, "anchor", "at", "n", "lone", "crowd"), width), "cuts")
    return inside.union(_by_arrays(cut.where("not crowd"), width)).union(_by_hashes(cut.where("crowd"), width))


def spans(at: np.ndarray, n: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches [from, to) covered by windows."""
    order = np.argsort(at)
    start, end = at[order], np.maximum.accumulate((at + n - 1 + width)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    return list(zip(start[first].tolist(), end[last].tolist()))


def deduplicated(docs: DataFrame, width: int = 400) -> DataFrame:
    """Documents (doc_id, text) without the bytes covered by a string of ``width`` bytes
    that also starts anywhere else, in the same document or another.

    Returns doc_id, ``n_bytes``, ``kept`` (binary: the remaining bytes) and ``spans``
    (start, length of the maximal removed runs). Null counts as empty. Rows equal in
    id *and* text are one document and no copies of each other; rows with different
    ids, or one id and different texts, are."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, removed = [], [], []
            for text, found in zip(utf8(batch.column("text")), batch.column("found")):
                text = text or b""
                own = spans(*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in fields(found, "at", "n")), width) if found.is_valid else []
                cuts = [0, *(x for s in own for x in s), len(text)]
                sizes.append(len(text))
                kept.append(b"".join([text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]))
                removed.append([{"start": a, "length": b - a} for a, b in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kinds)], ["doc_id", "n_bytes", "kept", "spans"])

    rows = with_texts(docs, repeats(docs, width), "at", "n").select("doc_id", "text", "found")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,length:bigint>>")
