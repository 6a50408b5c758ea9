"""Exact dedup by an exchange of Golomb-coded fingerprints.

Rows are staged once, in blocks that stay where they are (the senders). A sender sorts its
fingerprints and sends each owner - a range of the fingerprints' values - the gaps between
them, Golomb-coded. The owner answers with a bitmap: which of these values another sender
has too. Only the rows so suspected, and those that a block holds twice itself, send their
texts, and what is equal is decided by the texts' bytes.

Fingerprints are cut to 10 bits more than the number of rows needs, so that about one row
in a thousand is suspected without cause and a value costs some ten bits and the logarithm
of the number of senders.

The staged table is bucketed by sender: the bitmaps meet the texts without a shuffle of
texts. A text with any number of copies is one value for each sender, and one row for each
task when suspects are grouped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

#: Bits of a row's place within its sender: a sender has a million rows at most.
PLACES = 20
#: Bits of a fingerprint beyond those that number the rows.
SPARE = 10
#: Rows that an owner answers for at most, on average.
OWNED = 1 << 22


def golomb(values: np.ndarray, width: int) -> tuple[int, bytes, bytes]:
    """Divisor bits, quotients and remainders of the gaps of ascending ``values`` below ``width``.

    The divisor is the power of two next below the usual one, 0.69 times the mean gap;
    quotients are unary, remainders have as many bits as the divisor.
    """
    k = max(0, int(math.log2(max(1.0, width / len(values) * math.log(2)))))
    gaps = np.diff(values, prepend=0)
    ends = np.cumsum(gaps >> k) + np.arange(len(values))
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def ungolomb(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The ``n`` values that ``golomb`` has coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum(gaps + (bits << np.arange(k, dtype=np.int64)).sum(axis=1))


def _cut(prints: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints of ``bits`` bits, ascending; the number of each row's; how often each is there."""
    whole = prints.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.unique((whole >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True, return_counts=True)


def _sent(bits: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """A sender's messages: a row for each owner of one of its fingerprints."""

    def messages(table: pa.Table) -> pa.Table:
        values, _, _ = _cut(table["print"].combine_chunks(), bits)
        owner, at = np.unique(values // width, return_index=True)
        sender = table["sender"][0].as_py()
        coded = [(len(own), *golomb(own - o * width, width)) for o, own in zip(owner.tolist(), np.split(values, at[1:]))]
        n, k, unary, rest = zip(*coded)
        return pa.table({"owner": pa.array(owner, pa.int64()), "sender": pa.array([sender] * len(n), pa.int64()), "n": pa.array(n, pa.int64()), "k": pa.array(k, pa.int32()), "unary": pa.array(unary, pa.binary()), "rest": pa.array(rest, pa.binary())})

    return messages


def _answered(table: pa.Table) -> pa.Table:
    """An owner's answers: for each message the bitmap of its values that another message has too."""
    n = table["n"].to_numpy()
    values = np.concatenate([ungolomb(*m) for m in zip(n.tolist(), *(table[c].to_pylist() for c in ("k", "unary", "rest")))])
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    again = np.split(count[number] > 1, np.cumsum(n)[:-1])
    return pa.table({"owner": table["owner"], "sender": table["sender"], "again": pa.array([np.packbits(x).tobytes() for x in again], pa.binary())})


def _received(bits: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A sender's rows and the answers to it: a bit for each place, 64 in a number."""

    def suspects(rows: pa.Table, answers: pa.Table) -> pa.Table:
        values, number, count = _cut(rows["print"].combine_chunks(), bits)
        _, n = np.unique(values // width, return_counts=True)
        maps = answers.sort_by("owner")["again"].to_pylist()
        again = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=c) for m, c in zip(maps, n.tolist(), strict=True)])
        place = rows["place"].to_numpy()
        flags = np.zeros((int(place.max()) // 64 + 1) * 64, np.uint8)
        flags[place] = (again | (count > 1))[number]
        return pa.table({"sender": rows["sender"].slice(0, 1), "flags": pa.array([np.packbits(flags, bitorder="little").view(np.int64)], pa.list_(pa.int64()))})

    return suspects


def _same(text: Column) -> Column:
    return text


class _Staged:
    """The staged rows with the verdict on each: ``suspect`` by the exchange, then classes by bytes."""

    def __init__(self, docs: DataFrame, normalise: Callable[[Column], Column], whole: bool):
        spark = docs.sparkSession
        self.name = f"spark_catalog.default.hammerprice_exact_{uuid.uuid4().hex}"
        text = F.coalesce(normalise(F.col("text")), F.lit(""))
        row = F.struct(*docs.columns) if whole else F.struct("doc_id")
        number = F.monotonically_increasing_id()
        raw = text.cast("binary")
        staged = docs.select(row.alias("row"), "doc_id", text.alias("text"), F.shiftright(number, PLACES).alias("sender"), number.bitwiseAND((1 << PLACES) - 1).cast("int").alias("place"), F.xxhash64(raw).alias("print"), F.unhex(F.sha2(raw, 256)).alias("sha"))
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(spark)}/{self.name.rpartition('.')[2]}"
        staged.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "sender").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def judged(self) -> DataFrame:
        """The staged rows with ``suspect``."""
        prints = self.rows.select("sender", "place", "print")
        total = prints.count()
        bits = min(62, max(1, total - 1).bit_length() + SPARE)
        partitions = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        owners = max(-(-total // OWNED), min(partitions, total >> 8), 1)
        width = -(-(1 << bits) // owners)
        messages = prints.groupBy("sender").applyInArrow(_sent(bits, width), "owner bigint, sender bigint, n bigint, k int, unary binary, rest binary")
        answers = messages.groupBy("owner").applyInArrow(_answered, "owner bigint, sender bigint, again binary")
        flags = prints.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(_received(bits, width), "sender bigint, flags array<bigint>")
        flags = written(flags, "exact-flags")
        met = self.rows.join(flags.hint("shuffle_hash"), "sender")
        bit = F.getbit(F.get("flags", F.shiftright("place", 6)), F.col("place").bitwiseAND(63))
        return met.withColumn("suspect", bit == 1).drop("flags")

    def classes(self, judged: DataFrame) -> DataFrame:
        """``print, sha, top, size`` for each suspected text; ``top`` is the row that stays.

        Rows are one class if their texts have the same bytes: the text itself is a grouping
        key, summed within each task before its one copy moves.
        """
        equal = judged.where("suspect").groupBy("print", "sha", "text").agg(F.max(F.struct("doc_id", "sender", "place")).alias("top"), F.count(F.lit(1)).alias("size"))
        named = equal.groupBy("print", "sha").agg(F.count(F.lit(1)).alias("texts"), F.max("top").alias("top"), F.sum("size").alias("size"))
        twice = F.raise_error(F.lit("two texts have one fingerprint and one SHA-256"))
        return written(named.select("print", "sha", F.when(F.col("texts") == 1, F.col("top")).otherwise(twice).alias("top"), "size"), "exact-classes")

    def verdicts(self) -> DataFrame:
        """``row, doc_id, sha, keep_id, group_size, kept`` of every row."""
        judged = self.judged()
        alone = judged.where("not suspect").select("row", "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
        met = judged.where("suspect").select("row", "doc_id", "sha", "print", "sender", "place").join(self.classes(judged), ["print", "sha"])
        kept = (F.col("sender") == F.col("top.sender")) & (F.col("place") == F.col("top.place"))
        return alone.union(met.select("row", "doc_id", "sha", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept")))

    def done(self, result: DataFrame, name: str) -> DataFrame:
        """``result`` as a written table; the catalogue forgets the staged one."""
        result = written(result, name)
        result.sparkSession.sql(f"DROP TABLE {self.name}")
        return result


def duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha`` for every row of ``docs`` (doc_id, text).

    Texts are equal if identical after ``normalise`` (as they are, by default); ``sha`` is the
    SHA-256 of the normalised text. Of equal texts the row with the largest doc_id stays:
    ``kept`` is true for exactly one row of a group. Null texts count as empty ones, and all
    empty texts are one group; a null doc_id is smaller than any other, ``keep_id`` is null
    only if all of the group are. Of rows equal in text and doc_id any one stays. An empty
    table gives an empty result. Other columns are not read.
    """
    staged = _Staged(docs.select("doc_id", "text"), normalise, whole=False)
    return staged.done(staged.verdicts().drop("row"), "exact")


def deduplicated(docs: DataFrame, normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """The rows of ``docs`` that stay (see ``duplicates``), with all their columns as they were."""
    staged = _Staged(docs, normalise, whole=True)
    return staged.done(staged.verdicts().where("kept").select("row.*"), "exact")
