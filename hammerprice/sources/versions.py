"""Tables that are replaced in parts, version by version.

A version is a small manifest: for each bucket of keys the folder that holds its rows and how
many they are. A merge reads and writes the touched buckets only, into a new folder, checks
that no bucket has lost rows, and then claims the next version's number. Who finds it taken
merges once more, over what the other has written. Readers follow a manifest, so they never
meet half a table; folders that no kept version needs can be dropped later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import children, claim, drop, read_text

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class ShrinkError(ValueError):
    """A merge would lose rows."""


class ConflictError(RuntimeError):
    """Other writers were faster, twice."""


@dataclass
class Version:
    number: int
    schema: str
    #: Bucket: (folder, rows).
    buckets: dict[int, tuple[str, int]] = field(default_factory=dict)
    #: Streams: the last batch that is in this version.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """A table under ``root`` in ``buckets`` buckets by ``keys``, which are not null in any merge that combines by them."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.size = spark, root.rstrip("/"), keys, buckets

    def _manifest(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in children(self.spark, f"{self.root}/versions"))

    def version(self, number: int | None = None) -> Version | None:
        """A version, the latest by default; None of a table that nobody has written yet."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        found = json.loads(read_text(self.spark, self._manifest(number)))
        return Version(found["number"], found["schema"], {int(b): tuple(v) for b, v in found["buckets"].items()}, found["batches"])

    def _folders(self, version: Version, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{folder}" for b, (folder, rows) in version.buckets.items() if rows and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self._folders(version)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.size)).cast("int")

    def _merged(self, base: Version | None, incoming: DataFrame, combine: Combine, guard: bool) -> Version:
        """The next version, written but not claimed."""
        touched = {r[0] for r in incoming.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets at most
        base = base or Version(0, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema))
        current = self._folders(base, touched)
        out = combine(current, incoming).select(*current.columns).withColumn("_bucket", self._bucket())
        folder = f"data/{uuid.uuid4().hex}"
        out.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        there = [n for n in children(self.spark, f"{self.root}/{folder}") if n.startswith("_bucket=")]
        counts = {r["_bucket"]: r["n"] for r in self.spark.read.parquet(f"{self.root}/{folder}").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()} if there else {}
        new = Version(base.number + 1, base.schema, dict(base.buckets), dict(base.batches))
        for b in touched | set(counts):
            before, after = base.buckets.get(b, ("", 0))[1], counts.get(b, 0)
            if guard and after < before:
                drop(self.spark, f"{self.root}/{folder}")
                raise ShrinkError(f"bucket {b}: {after} rows would replace {before}")
            new.buckets[b] = (f"{folder}/_bucket={b}", after)
        return new

    def merge(self, incoming: DataFrame, combine: Combine, guard: bool = True, stream: str | None = None, batch: int = 0) -> int:
        """Combines ``incoming`` with the rows of its buckets; returns the version that holds it.

        ``combine(current, incoming)`` gives the new rows of these buckets. With ``guard`` a
        bucket that would lose rows stops the merge and nothing changes. A batch of a stream
        that the table already holds is passed over. One retry if another writer was faster."""
        for _ in range(2):
            base = self.version()
            if stream and base and base.batches.get(stream, -1) >= batch:
                return base.number
            new = self._merged(base, incoming, combine, guard)
            if stream:
                new.batches[stream] = batch
            text = json.dumps({"number": new.number, "schema": new.schema, "buckets": new.buckets, "batches": new.batches})
            if claim(self.spark, self._manifest(new.number), text):
                return new.number
        raise ConflictError(f"version {new.number} of {self.root} was taken")

    def upsert(self, incoming: DataFrame, guard: bool = True, **more) -> int:
        """Rows of equal keys are replaced by the incoming ones, field by field where these are not null."""

        def combine(current: DataFrame, new: DataFrame) -> DataFrame:
            values = [c for c in current.columns if c not in self.keys]
            other = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.struct(*[F.col(c) for c in values], F.lit(True).alias("_there")).alias("_new"))
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
            both = current.withColumn("_here", F.lit(True)).join(other, same, "full_outer")
            own = [F.when(F.col("_here").isNotNull(), F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(self.keys)]
            return both.select(*own, *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in values])

        return self.merge(incoming, combine, guard, **more)

    def replace(self, incoming: DataFrame, guard: bool = False, **more) -> int:
        """All rows of the incoming keys are replaced by the incoming ones."""
        return self.merge(incoming, lambda current, new: current.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new), guard, **more)

    def delete(self, gone: DataFrame) -> int:
        """Rows of the keys in ``gone`` go."""
        return self.merge(gone, lambda current, keys: current.join(keys.select(*self.keys).distinct(), self.keys, "left_anti"), guard=False)

    def absorb(self, stream: DataFrame, name: str, checkpoint: str, combine: Callable[[DataFrame], DataFrame] | None = None):
        """A stream's batches as upserts, each exactly once; ``combine`` makes a batch one row for each key."""

        def each(batch: DataFrame, number: int) -> None:
            self.upsert(combine(batch) if combine else batch, guard=True, stream=name, batch=number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

    def expire(self, keep: int) -> list[str]:
        """Drops all but the latest ``keep`` versions and the folders that only they need; run it while nobody writes."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        needed = {folder.split("/")[1] for v in kept for folder, _ in v.buckets.values()}
        gone = [n for n in children(self.spark, f"{self.root}/data") if n not in needed]
        for n in numbers[:-keep]:
            drop(self.spark, self._manifest(n))
        for n in gone:
            drop(self.spark, f"{self.root}/data/{n}")
        return gone
