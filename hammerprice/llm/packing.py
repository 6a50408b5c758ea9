"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. A round range-sorts the documents that are left and the
gaps of the open sequences, longest first and gaps before documents of their length,
and sweeps over them: each document takes the nearest gap before it that no document
in between has taken, that is the smallest one that holds it and is still free when
the documents come longest first. The sweep is a matching of brackets. Each range
counts its own gaps and documents; with the sums of the ranges before it every row
knows its level, and within a level gaps and documents alternate. Documents without
a gap know their rank among such; the longest of them open new sequences, as many
together as fit. Then the gaps are updated and the next round begins.

A gap of several times the longest document left stands in the sweep as several gaps.
The number of rounds follows from the lengths, not from the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, written
from .tokens import encoder

_PIECES = "id bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: only documents of over ``capacity`` tokens are cut, the
    first piece takes what whole sequences leave over. ``id`` names a piece (task and number
    in it, so write the table before use); ``ids`` is null unless ``keep_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 33
        encode_all, end = encoder(tokenizer).encode_all, np.array([end_id], "<u4").tobytes()
        for batch in small(batches, 1):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1))):
                data = ids + end
                n = len(data) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    own = data[4 * i : 4 * j]
                    out.append((name, doc, k, i, j - i, zlib.crc32(own), own if keep_ids else None))
                    name += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def _swept(items: DataFrame) -> DataFrame:
    """``items`` (size, kind 0 gap or 1 document, id, slot) range-sorted, with ``part`` (the range),
    ``sum`` (gaps less documents of the range so far) and ``low`` (the least such sum before the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, low = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = total + np.cumsum(1 - 2 * batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64))
            lows = np.minimum.accumulate(np.concatenate(([low], sums)))
            total, low = int(sums[-1]), int(lows[-1])
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(sums), pa.array(lows[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "sum", "low"])

    order = [F.desc("size"), "kind", "id", "slot"]
    return items.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "size bigint, kind int, id bigint, slot int, part int, sum bigint, low bigint")


def _matched(swept: DataFrame) -> DataFrame:
    """The documents of a sweep: id, length, sequence_id and slot of their gap, or their ``rank``
    among those without one."""
    kinds = F.when(F.col("kind") == 0, 1).otherwise(-1)
    ranges = swept.groupBy("part").agg(F.sum(kinds).alias("total"), F.least(F.min("sum"), F.lit(0)).alias("least"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = ranges.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    ranges = ranges.withColumn("floor", F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("least")).over(before), F.lit(0))))
    rows = swept.join(F.broadcast(ranges.select("part", "base", "floor")), "part")
    rows = rows.withColumn("at", F.col("base") + F.col("sum")).withColumn("lowest", F.least("floor", F.col("base") + F.col("low")))
    alone = (F.col("kind") == 1) & (F.col("at") < F.col("lowest"))
    level = F.when(~alone, F.col("at") - F.col("lowest") + F.col("kind"))
    # A level has a gap and a document for each length at most; unmatched documents, a level each.
    rows = rows.select("size", "kind", "id", "slot", F.coalesce(level, F.col("at")).alias("level"), F.when(alone, -1 - F.col("at")).alias("rank"))
    along = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    gap = F.when(F.col("rank").isNull(), F.lag(F.struct("id", "slot")).over(along))
    rows = rows.withColumn("gap", gap).where("kind = 1")
    return rows.select("id", F.col("size").alias("length"), F.col("gap.id").alias("sequence_id"), F.col("gap.slot").alias("slot"), "rank")


def _opened(found: DataFrame, longest: int, capacity: int, first: int) -> DataFrame:
    """``found`` with new sequences, from number ``first``, for the longest documents without a gap.

    ``floor(capacity / length)`` documents of that number stand together, in order of length. Where
    not even one sequence would be full its documents wait for a gap, but for the longest ones'."""
    most = capacity // longest
    threshold = max(longest // (2 if most < 8 else 4), capacity // (most + 1) if most <= 2 else 0)
    each = F.floor(F.lit(capacity) / F.col("length")).cast("bigint")
    waiting = F.col("rank").isNotNull() & (F.col("length") > threshold)
    groups = found.where(waiting).groupBy(each.alias("each")).agg(F.min("rank").alias("from"), F.count(F.lit(1)).alias("documents"))  # two roots of the capacity rows at most
    groups = groups.where((F.col("documents") >= F.col("each")) | (F.col("each") == most))
    earlier = Window.orderBy("each").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.lit(first) + F.coalesce(F.sum(F.ceil(F.col("documents") / F.col("each"))).over(earlier), F.lit(0)))
    found = found.withColumn("each", F.when(waiting, each)).join(F.broadcast(groups), "each", "left")
    nth = F.col("rank") - F.col("from")
    number = F.coalesce("sequence_id", (F.col("base") + F.floor(nth / F.col("each"))).cast("bigint"))
    return found.select("id", "length", number.alias("sequence_id"), F.coalesce("slot", (nth % F.col("each")).cast("int")).alias("slot"), (F.col("base").isNotNull() & (nth % F.col("each") == 0)).alias("opens"))


def best_fit(lengths: DataFrame, capacity: int) -> DataFrame:
    """Places ``lengths`` (id, length from 1 to ``capacity``): id, length, sequence_id (from 0, no
    number left out) and offset."""
    left = lengths.select("id", "length")
    gaps = left.limit(0).select(F.col("id").alias("sequence_id"), F.col("length").alias("room"))
    scope = left.agg(F.min("length"), F.max("length")).first()
    placed, sequences, largest = [], 0, 0
    while scope[1] is not None:
        shortest, longest = scope
        items = left.select(F.col("length").alias("size"), F.lit(1).alias("kind"), "id", F.lit(0).alias("slot"))
        if largest >= shortest:
            times = F.greatest(F.floor(F.col("room") / longest), F.lit(1)).cast("int")
            slots = gaps.where(F.col("room") >= shortest).select("sequence_id", "room", times.alias("times")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
            size = F.when(F.col("slot") < F.col("times") - 1, longest).otherwise(F.col("room") - (F.col("times") - 1) * longest)
            items = items.union(slots.select(size.cast("bigint"), F.lit(0), "sequence_id", "slot"))
        found = _matched(written(_swept(items), "sweep"))
        if largest < longest:
            found = _opened(found, longest, capacity, sequences)
        else:
            found = found.select("id", "length", "sequence_id", "slot", F.lit(False).alias("opens"))
        found = written(found, "round")
        done, left = found.where("sequence_id is not null"), found.where("sequence_id is null").select("id", "length")
        placed.append(done.select("id", "length", "sequence_id", F.lit(len(placed)).alias("round"), "slot"))
        change = done.select("sequence_id", (F.when(F.col("opens"), capacity).otherwise(0) - F.col("length")).alias("room"))
        gaps = written(gaps.union(change).groupBy("sequence_id").agg(F.sum("room").alias("room")).where("room > 0"), "gaps")
        known = found.select(F.when(F.col("sequence_id").isNull(), F.col("length")).alias("length"), F.when(F.col("opens"), F.col("sequence_id")).alias("new"), F.lit(None).cast("bigint").alias("room"))
        known = known.union(gaps.select(F.lit(None), F.lit(None), "room")).agg(F.min("length"), F.max("length"), F.max("new"), F.max("room")).first()
        scope, sequences, largest = known[:2], max(sequences, -1 if known[2] is None else known[2] + 1), known[3] or 0
    rows = placed[0] if placed else left.select("id", "length", F.col("id").alias("sequence_id"), F.lit(0).alias("round"), F.lit(0).alias("slot"))
    for more in placed[1:]:
        rows = rows.union(more)
    before = Window.partitionBy("sequence_id").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)  # capacity rows at most
    return rows.select("id", "length", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """All documents (doc_id, text) packed into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and ``end_id``; null and empty texts are that
    id alone. Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``keep_ids`` the piece's ids (little-endian
    unsigned 32 bit). Sequences are filled from 0 without gaps. Repeated rows are
    packed as often as they come; a null doc_id stays null; no rows give no rows."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    places = best_fit(cut, capacity).select("id", "sequence_id", "offset")
    return cut.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
