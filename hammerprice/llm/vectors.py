"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine ``c`` or more lie within squared distance 2 - 2c. A fixed random
rotation spreads that distance over all coordinates; these are split into blocks, and
a pair within the distance must be within its proportional share in one block at
least. So each block is range-joined by itself on a grid of its first coordinates:
a vector stands in its cell and visits the later neighbour cells that its share
reaches. Pairs that meet within the share are verified by their exact cosine, in the
first block only that finds them. A cell gives back link counts and spanning links,
never its pairs. Equal vectors fall together before any search.

Rotated coordinates are rounded to whole multiples of 2^-20 (the shares are widened by
as much), so that distances are exact whole numbers and all tasks decide alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mixed
from .shared import components, written

BLOCKS = 4
#: Rows that a cell should hold; the grid takes as many coordinates as that needs.
CELL = 1024
#: A cell with more rows is met part by part.
CROWD = 8192
#: Up to so many crowded cells are sent to all tasks; more meet their rows by a shuffle.
SENT = 1 << 20
SCALE = 1 << 20
#: Rows of a cell that are compared with all its rows at once.
TILE = 256


class Grid:
    """Rotation, blocks and cells for vectors of ``d`` components."""

    def __init__(self, d: int, cosine: float, largest: int):
        rotation = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
        self.rotation = rotation * SCALE
        edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        reach = [sqrt(max(0.0, 2 - 2 * cosine) * (b - a) / d) * SCALE + sqrt(b - a) + 1 for a, b in self.blocks]
        self.reach, self.share = reach, [r * r for r in reach]
        self.axes = [min(b - a, max(0, ceil(log(max(1, largest) / CELL, 2.2)))) for a, b in self.blocks]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.rint(x / np.sqrt((x * x).sum(axis=1, keepdims=True)) @ self.rotation)

    def cells(self, z: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(block, rows, cell numbers, visiting) for all the cells where each row stands or visits.

        Axis by axis, what has come too far from its own cell for its reach is left; of two
        neighbour cells only the one whose first different axis is higher is visited."""
        for b, (first, _) in enumerate(self.blocks):
            width = 2 * self.reach[b]
            rows, far, later = np.arange(len(z)), np.zeros(len(z)), np.zeros(len(z), bool)
            cell = np.full(len(z), b + 1, np.uint64)
            for own in z[:, first : first + self.axes[b]].T:
                home = np.floor(own / width)
                up, down = ((home + 1) * width - own)[rows] ** 2 + far, (own - home * width)[rows] ** 2 + far
                higher = np.flatnonzero(up <= self.share[b])
                lower = np.flatnonzero((down <= self.share[b]) & later)
                at = np.concatenate((np.arange(len(rows)), higher, lower))
                step = np.concatenate((np.zeros(len(rows), np.int64), np.ones(len(higher), np.int64), np.full(len(lower), -1)))
                far, later = np.concatenate((far, up[higher], down[lower])), later[at] | (step > 0)
                cell = mixed(cell[at] * np.uint64(0x9E3779B97F4A7C15) + (home[rows][at].astype(np.int64) + step).view(np.uint64))
                rows = rows[at]
            for visiting in (False, True):
                some = later == visiting
                yield b, rows[some], cell[some].view(np.int64), visiting


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Union:
    """Groups of the rows of a cell, and the links that made them."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = np.array([self.root(i) for i in range(len(self.parent))])
        ra, rb = roots[a], roots[b]
        apart = np.flatnonzero(ra != rb)
        if len(apart):
            _, some = np.unique(np.minimum(ra, rb)[apart] * len(roots) + np.maximum(ra, rb)[apart], return_index=True)
            for k in apart[some].tolist():
                x, y = self.root(int(a[k])), self.root(int(b[k]))
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.links.append((int(a[k]), int(b[k])))


def linked(x: np.ndarray, size: np.ndarray, visiting: np.ndarray, part: np.ndarray, grid: Grid, block: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the rows of a cell: linked vectors of each, and spanning links. Two visitors are no
    pair here; nor are two rows of the same part if there are two parts."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact; squares of huge or tiny components stay numbers
    z = grid.rotated(x)
    first, last = grid.blocks[block]
    own = z[:, first:last]
    norm = (own * own).sum(axis=1)
    lengths = np.sqrt((x * x).sum(axis=1))
    count, groups = np.zeros(len(x), np.int64), Union(len(x))
    several = len(np.unique(part)) > 1
    for at in range(0, len(x), TILE):
        rows = slice(at, at + TILE)
        near = norm[rows, None] + norm[None, at:] - 2 * (own[rows] @ own[at:].T) <= grid.share[block]
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        keep = (i < j) & ~(visiting[i] & visiting[j])
        if several:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            for e in range(block):  # pairs that an earlier block finds are its own
                s, t = grid.blocks[e]
                step = z[a, s:t] - z[b, s:t]
                new = (step * step).sum(axis=1) > grid.share[e]
                a, b = a[new], b[new]
            found = np.einsum("ij,ij->i", x[a], x[b]) / (lengths[a] * lengths[b]) >= cosine
            a, b = a[found], b[found]
            count += np.bincount(a, size[b], len(x)).astype(np.int64) + np.bincount(b, size[a], len(x)).astype(np.int64)
            groups.join(a, b)
    return count, groups.links


def _met(classes: DataFrame, cosine: float, largest: int) -> DataFrame:
    """cell, part, node, size, visiting, block, embedding: each class of vectors in its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, Grid] = {}
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                some = batch.take(pa.array(np.flatnonzero(lengths == d)))
                grid = grids.setdefault(d, Grid(d, cosine, largest))
                label = some.column("label_hash").to_numpy(zero_copy_only=False).view(np.uint64)
                for block, rows, cell, visiting in grid.cells(grid.rotated(_matrix(some.column("embedding")))):
                    cell = mixed(cell.view(np.uint64) ^ mixed(label[rows] + np.uint64(d))).view(np.int64)
                    own = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), own.column("node"), own.column("size"), pa.array(np.full(len(rows), visiting)), pa.array(np.full(len(rows), block, np.int32)), own.column("embedding")], ["cell", "node", "size", "visiting", "block", "embedding"])

    rows = classes.select("node", "size", F.xxhash64("label").alias("label_hash"), F.col("embedding").cast("array<double>"))
    schema = "cell bigint, node bigint, size bigint, visiting boolean, block int, embedding array<double>"
    return rows.mapInArrow(run, schema).withColumn("embedding", F.col("embedding").cast(classes.schema["embedding"].dataType))


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """kind 0: ``a`` has ``n`` linked vectors more; kind 1: a spanning link ``a``, ``b``.

    ``classes`` has a row per distinct vector: node, size (vectors equal to it), label, embedding."""
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    met = written(_met(classes, cosine, largest), "cells")
    crowded = written(met.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWD), "crowded")
    many = crowded.count()
    dealt = met.withColumn("part", F.lit(0)).withColumn("meeting", F.lit(0).cast("bigint"))
    if many:
        parts = F.coalesce(F.ceil(F.col("rows") / (CROWD // 2)), F.lit(1)).cast("int")
        dealt = met.join(F.broadcast(crowded) if many <= SENT else crowded, "cell", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", "visiting"), "parts").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumn("meeting", F.least("part", "other") * F.lit(1 << 20).cast("bigint") + F.greatest("part", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, Grid] = {}

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            rows = table.to_batches()[0] if table.num_rows else None
            if rows is None:
                return
            x = _matrix(rows.column("embedding"))
            grid = grids.setdefault(x.shape[1], Grid(x.shape[1], cosine, largest))
            node, size, visiting, part = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "visiting", "part"))
            count, found = linked(x, size, visiting, part, grid, int(rows.column("block")[0].as_py()), cosine)
            some = np.flatnonzero(count)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            kind = np.concatenate((np.zeros(len(some), np.int32), np.ones(len(pairs), np.int32)))
            a = np.concatenate((node[some], node[pairs[:, 0]]))
            b = np.concatenate((np.zeros(len(some), np.int64), node[pairs[:, 1]]))
            n = np.concatenate((count[some], np.zeros(len(pairs), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (kind, a, b, n)], ["kind", "a", "b", "n"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            cell, meeting = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "meeting"))
            new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(meeting) != 0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(cell)]):
                if i == j:
                    continue
                this = (cell[i], meeting[i])
                if held and this != now:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                now = this
                held.append(batch.slice(i, j - i))
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = dealt.select("cell", "meeting", "node", "size", "visiting", "block", "part", "embedding")
    dealt = dealt.repartition("cell", "meeting").sortWithinPartitions("cell", "meeting")
    return dealt.mapInArrow(run, "kind int, a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``
    (vec_id, embedding, label).

    Rows of equal, not null label and equally many components link if their cosine, in
    double precision, is ``cosine`` or more. Vectors that are null, empty, zero or have
    null or non-finite components link with nothing, nor do rows without a vec_id (these
    have a null component_id and are kept). Every row is a vector: repeated rows link
    with each other. ``component_id`` is the smallest vec_id reachable by links."""
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0)
    sound &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    rows = rows.select("*", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "label", "embedding").alias("k2"))
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes, "vectors")
    found = written(links(classes, cosine), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.select("k1", "k2", "node", "size").join(counts, "node", "left").join(components(found.where("kind = 1").select("a", "b")), "node", "left")
    named = named.select("k1", "k2", F.lit(True).alias("sound"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "node").alias("name"))
    out = rows.select("vec_id", "sound", "k1", "k2").join(named, ["k1", "k2", "sound"], "left")
    name = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("vec_id") == name, F.lit(True)).alias("kept"))
