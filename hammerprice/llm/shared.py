"""What the corpus operators share: written tables, byte columns and connected components.

Conventions that hold for every operator of this subpackage:

* only the columns that an operator names are read; all others (also ones whose
  names clash with an output column) are ignored, except where a text-rewriting
  operator hands its input columns on;
* a null text counts as an empty one unless the operator's docstring says otherwise;
* rows with equal id *and* equal text are one document met twice: both rows get
  the same result. Rows with equal id and different texts are told apart by a
  hash of the text;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies, if nobody has told them how."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


#: Of Python workers: freed blocks of many MB go back to the system, where the defaults keep them
#: in the worker for its life. Arrays of up to a million numbers are below that, so that they stay cheap.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 24), "MALLOC_TRIM_THRESHOLD_": str(1 << 25)}


def frugal(spark: SparkSession) -> None:
    """Lets Python workers give memory back, if nobody has told them how to allocate."""
    for name, value in FRUGAL.items():
        spark.sparkContext.environment.setdefault(name, value)


_HELD: dict[Hashable, Any] = {}


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, done once for a ``name`` and kept by this Python worker until another name is
    asked for: a worker lives on through the stages of a job, and what an earlier stage has opened
    and filled (a tokenizer's memos) must not stand beside what the next one needs."""
    if name not in _HELD:
        let_go()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """What this worker holds from an earlier stage goes back to the system."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()  # with the system's allocator all that is free


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset - local mode, as in tests - a temporary folder is chosen
    and set. On a cluster a missing setting is an error: a machine-local folder
    would be unreadable for the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back.

    It cuts the lineage like ``checkpoint()``: a lost executor costs only its
    running tasks. Columns survive as they are; ``partition_by`` lays out folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hammerprice-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of the column ``text``: words as
    Python objects take ten times as much."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def fields(found: pa.ListScalar, *names: str) -> list[pa.Array]:
    """The named fields of one row's array of structs, as arrays."""
    own = found.values
    flat = dict(zip((f.name for f in own.type), own.flatten()))
    return [flat[n] for n in names]


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: columns ``node`` and ``component``.

    ``edges`` has two bigint columns; a component is named by its smallest node.
    Loops and repeated edges are harmless, rows with a null end are ignored; nodes
    without an edge to another node don't appear. Method: alternating large-star
    and small-star rounds. Minima are pre-aggregated before each shuffle and met
    again by a join, so that a hub's edges are never gathered in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = star.where("u != v")
        low = _mins(star)
        e = star.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(e, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    out = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
