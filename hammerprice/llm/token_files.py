"""Token ids in directly addressable codes, written as binary blocks and read back.

A block holds whole documents in ascending doc_id order. Their ids, one after
another, are cut into 8-bit chunks: level 0 has the lowest chunk of every id, level
k the next chunk of those ids that have one. A continuation bitmap beside each level
marks the ids that go on, and a rank directory (set bits before every 512th entry)
says where they go on, so that ``token(block, i)`` reads any id directly.

Layout, little endian: ``DAC1``, u32 levels, u64 documents, u64 tokens, then the
documents' first positions (u64 each, and the end), then for each level u64 n, the
bitmap (n bits in whole bytes), the rank directory (u32 for each 512 entries) and n
chunk bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder

#: A block is closed when it has so many tokens; a longer document has a block of its own.
BLOCK_TOKENS = 1 << 20
STEP = 512
_HEAD = struct.Struct("<4sIQQ")


def encode_block(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """A block of ``ids`` (unsigned 32 bit); document d has ``ids[bounds[d]:bounds[d + 1]]``."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little").tobytes()
        ranks = np.concatenate(([0], np.cumsum(more, dtype=np.int64)))[: len(rest) : STEP]
        levels.append(struct.pack("<Q", len(rest)) + bits + ranks.astype("<u4").tobytes() + (rest & 255).astype(np.uint8).tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return _HEAD.pack(b"DAC1", len(levels), len(bounds) - 1, len(ids)) + bounds.astype("<u8").tobytes() + b"".join(levels)


def _levels(block: bytes) -> tuple[int, int, np.ndarray, list[tuple[int, int, int, int]]]:
    magic, levels, docs, tokens = _HEAD.unpack_from(block)
    if magic != b"DAC1":
        raise ValueError("not a block of token ids")
    bounds = np.frombuffer(block, "<u8", docs + 1, _HEAD.size)
    at, found = _HEAD.size + 8 * (docs + 1), []
    for _ in range(levels):
        (n,) = struct.unpack_from("<Q", block, at)
        bits = at + 8
        ranks = bits + (n + 7) // 8
        chunks = ranks + 4 * ((n + STEP - 1) // STEP)
        found.append((n, bits, ranks, chunks))
        at = chunks + n
    return docs, tokens, bounds, found


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block (unsigned 32 bit), and the documents' bounds."""
    _, tokens, bounds, levels = _levels(block)
    ids, at = np.zeros(tokens, np.uint32), np.arange(tokens)
    for k, (n, bits, _, chunks) in enumerate(levels):
        ids[at] |= np.frombuffer(block, np.uint8, n, chunks).astype(np.uint32) << np.uint32(8 * k)
        more = np.unpackbits(np.frombuffer(block, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little")
        at = at[more.view(bool)]
    return ids, bounds.astype(np.int64)


def token(block: bytes, i: int) -> int:
    """The i-th id of a block, from a few bytes of each level."""
    _, tokens, _, levels = _levels(block)
    if not 0 <= i < tokens:
        raise IndexError(i)
    value = 0
    for k, (_, bits, ranks, chunks) in enumerate(levels):
        value |= block[chunks + i] << 8 * k
        if not block[bits + i // 8] >> i % 8 & 1:
            break
        first = i // STEP * STEP
        before = int.from_bytes(block[bits + first // 8 : bits + i // 8], "little").bit_count()
        within = (block[bits + i // 8] & (1 << i % 8) - 1).bit_count()
        (rank,) = struct.unpack_from("<I", block, ranks + 4 * (i // STEP))
        i = rank + before + within
    return value


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Token blocks of all texts of ``docs`` (doc_id, text), in ascending doc_id order.

    Columns: ``part`` (number of the range of doc_ids), ``seq`` (place of the block
    in it), ``before`` (ids of that part before the block), ``tokens``, ``doc_ids``
    and ``block`` (binary). Every document ends with ``end_id``; null and empty
    texts have that id alone. Null doc_ids come first; rows with equal doc_ids stand
    in the order of their texts. The table is written by Spark's own writer into the
    shared folder, so it can be in any store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal seq, before, held
            bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
            data = encode_block(np.frombuffer(b"".join(ids), "<u4"), bounds)
            values = [[part], [seq], [before], [int(bounds[-1])], [list(names)], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            seq, before, held = seq + 1, before + int(bounds[-1]), 0
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["part", "seq", "before", "tokens", "doc_ids", "block"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text) + end
                if ids and held + len(data) // 4 > BLOCK_TOKENS:
                    yield block()
                ids.append(data)
                names.append(name)
                held += len(data) // 4
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, "part int, seq int, before bigint, tokens bigint, doc_ids array<bigint>, block binary"), "tokens")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Per document of ``blocks``: doc_id, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` of the ids as little-endian unsigned 32-bit numbers."""
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # a row per part
    first, at = {}, 0
    for part, n in totals:
        first[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, bounds = decode_block(row["block"])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                start = bounds[:-1] + (first[row["part"]] + row["before"])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "doc_ids", "block").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
