"""Writers: guarded replacement, appends without doubles, dated audit tables, files."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import children, drop
from .versions import ShrinkError

__all__ = ["ShrinkError", "append_audit", "append_new", "as_json", "drop_days", "from_json", "replace_guarded", "write_json_lines"]


def replace_guarded(df: DataFrame, path: str, before: int, newest_first: str | None = None, **options: str) -> str:
    """Writes ``df`` to a fresh folder beside ``path`` and returns it; refuses if it has fewer rows than
    ``before``, and then leaves nothing behind. The caller points readers at the new folder, so that
    nobody meets half a table. ``newest_first`` names a column that the rows are sorted by, falling."""
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    ordered = df.orderBy(F.desc_nulls_last(newest_first)) if newest_first else df
    ordered.write.options(**options).parquet(target)
    now = df.sparkSession.read.parquet(target).count()
    if now < before:
        drop(df.sparkSession, target)
        raise ShrinkError(f"{now} rows would replace {before}")
    return target


def append_new(df: DataFrame, path: str, keys: list[str], spark: SparkSession) -> DataFrame:
    """Appends the rows whose keys the table doesn't have, one for each key: the smallest, field by
    field in order. Returns them as they were written. Keys that are null are new each time."""
    known = spark.read.parquet(path).select(*keys)
    best = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in df.columns if c not in keys], F.lit(0))).alias("_row"))
    fresh = best.select(*keys, "_row.*").select(*df.columns).join(known, keys, "left_anti")
    part = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    fresh.write.parquet(part)
    written = spark.read.schema(df.schema).parquet(part)
    written.write.mode("append").parquet(path)
    return written


def append_audit(df: DataFrame, path: str, computed_at: str) -> None:
    """Appends to an audit table in folders by day; old days go by dropping their folders."""
    df.withColumn(f"{computed_at}_date", F.to_date(computed_at)).write.mode("append").partitionBy(f"{computed_at}_date").parquet(path)


def drop_days(spark: SparkSession, path: str, as_of: dt.date, days: int = 90) -> list[str]:
    """Drops the folders of an audit table that are over ``days`` old; returns their days."""
    oldest = (as_of - dt.timedelta(days=days)).isoformat()
    gone = [n for n in children(spark, path) if "_date=" in n and n.rpartition("=")[2] < oldest and n.rpartition("=")[2][:1].isdigit()]
    for n in gone:
        drop(spark, f"{path.rstrip('/')}/{n}")
    return sorted(n.rpartition("=")[2] for n in gone)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, without null fields."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    """The rows of ``as_json`` read back; what is no such row goes."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("_r")).where("_r._corrupt IS NULL").select("_r.*").drop("_corrupt")
