"""Anchored runs of windows: where equal windows of any two texts can meet.

A text is a row of units (words or bytes). A window of ``width`` units is owned by
one of its k-grams, the leftmost with the smallest hash. Equal windows are owned by
equal k-grams at the same place within them, so they meet in the index under their
owner's hash (the *anchor*). Consecutive windows with one owner form a *run*; the
units that a run covers are its *context*, known by a hash of its own. Runs of equal
context repeat each other window by window; only runs whose anchor has several
contexts need a closer look.

The index is spread by anchor. A place is a pair of doc_id (null: the largest
bigint) and ``at``, which holds 31 bits of the text's hash above the position, so
that rows of equal id and different texts are told apart and repeated rows are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import utf8, written

#: Units that are worked on at once; longer texts are cut with an overlap of a window.
CHUNK = 1 << 20
#: Rows of a key that one task may get, and keys that may be broadcast.
HOT, SENT = 20_000, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MOD = 1 << 64
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of a row of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if not _powers or len(_powers[0]) < n + 1:
            size = max(n + 1, CHUNK + 1024)
            steps = [np.full(size, base, np.uint64) for base in (_BASE, pow(_BASE, -1, _MOD))]
            for each in steps:
                each[0] = 1
            _powers[:] = [np.cumprod(each) for each in steps]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers[0][:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _powers[1][start])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k:] - self.sums[:n]) * _powers[1][:n])


def leftmost_smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values the place of its smallest, the leftmost if tied."""
    best, place, step = values, np.arange(len(values), dtype=np.int32), 1
    while step < span:
        d = min(step, span - step)
        right = best[d:] < best[:-d]
        best = np.where(right, best[d:], best[:-d])
        place = np.where(right, place[d:], place[:-d])
        step += d
    return place


def runs(values: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of texts that stand one after another in ``values`` and end at ``ends``:
    first window, number of windows, anchor, context hash."""
    if len(values) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(values)
    grams = rolling.grams(k)
    owner = leftmost_smallest(grams, width - k + 1)
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))[: len(owner)]
    whole = np.flatnonzero(np.arange(len(owner)) + width <= end)
    own = owner[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(whole) != 1)
    first = np.flatnonzero(new)
    lo = whole[first]
    n = np.diff(np.concatenate((first, [len(whole)])))
    return lo, n, grams[own[first]], rolling(lo, lo + n - 1 + width)


def chunks(lengths: list[int], width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of stretches (text, from, to) of about CHUNK units; each window is in just one."""
    group: list[tuple[int, int, int]] = []
    held = 0
    for d, n in enumerate(lengths):
        for at in range(0, max(1, n - width + 1), CHUNK):
            to = min(n, at + CHUNK + width - 1)
            if to - at < width:
                continue
            if held + to - at > CHUNK + width and group:
                yield group
                group, held = [], 0
            group.append((d, at, to))
            held += to - at
    if group:
        yield group


def key() -> list[Column]:
    """Columns that every stage knows a row of documents by: doc, t (31 bits of the text's hash)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).alias("t")]


Units = Callable[[bytes], np.ndarray]


def index(docs: DataFrame, units: Units, width: int, k: int, name: str) -> DataFrame:
    """The runs of all whole texts: anchor, context, doc, at, n (windows). Hashes of stretches are
    polynomials modulo 2^64, which can't tell apart certain texts of 1,024 units and more, so
    ``width`` is at most 512."""
    if width > 512:
        raise ValueError("windows of at most 512 units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            own: dict[int, np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                rows = list(own)
                for group in chunks([len(own[d]) for d in rows], width):
                    values = np.concatenate([own[rows[d]][a:b] for d, a, b in group])
                    ends = np.cumsum([b - a for _, a, b in group])
                    lo, n, anchor, context = runs(values, ends, width, k)
                    piece = np.searchsorted(ends, lo, side="right")
                    row = np.array([rows[d] for d, _, _ in group])[piece]
                    start = lo - (ends - [b - a for _, a, b in group])[piece] + np.array([a for _, a, _ in group])[piece]
                    columns = [anchor.view(np.int64), context.view(np.int64), doc[row], t[row] << np.int64(32) | start, n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "doc", "at", "n"])
                own.clear()

            held = 0
            for d, text in enumerate(utf8(batch.column(2))):
                own[d] = units(text or b"")
                held += len(own[d])
                if held > CHUNK:
                    yield from flush()
                    held = 0
            yield from flush()

    rows = docs.select(*key(), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, "anchor bigint, context bigint, doc bigint, at bigint, n int"), f"{name}-runs")


def met_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` (a row for each value of ``on``; ``times``: its rows in ``rows``).

    Keys of more than HOT rows, and more than one in SENT of all rows, meet them by a
    broadcast of SENT keys at most, so that no task gets all rows of a hot key."""
    most = max(HOT, rows.count() // SENT)
    hot, rest = keys.where(F.col("times") > most).drop("times"), keys.where(F.col("times") <= most).drop("times")
    if hot.isEmpty():
        return rows.join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def shared_contexts(all_runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The runs whose anchor occurs more than once, and their contexts: anchor, context,
    n, first (smallest place), again (whether there is another place), times (runs),
    contexts (how many the anchor has). Counts are summed before each shuffle."""
    often = all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    often = written(often, f"{name}-often")  # a plain table: large partitions of the joins can then be split
    met = written(met_by(all_runs, often, ["anchor"]), f"{name}-shared")
    place = F.struct("doc", "at")
    each = met.groupBy("anchor", "context").agg(F.min("n").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times"))
    each = written(each.select("anchor", "context", "n", "first", (F.col("first") != F.col("last")).alias("again"), "times"), f"{name}-contexts")
    many = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    many = written(many, f"{name}-many")
    return met, each.join(many, "anchor")


def with_texts(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, doc, t, text, found`` of the documents that have rows in ``found`` (doc, at,
    ...): an array of structs of ``columns``, in which ``at`` is the bare position.
    Documents without rows have null, those of ``found`` alone don't appear; what repeated
    rows found several times is there once."""
    position = F.col("at").bitwiseAND(0xFFFFFFFF).alias("at")
    each = found.select("doc", F.shiftright("at", 32).alias("t"), F.struct(*[position if c == "at" else F.col(c) for c in columns]).alias("x"))
    each = each.groupBy("doc", "t").agg(F.collect_set("x").alias("found"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *key()).join(each, ["doc", "t"], "left")
