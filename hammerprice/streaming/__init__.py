"""Structured Streaming: listing files as they land, daily first writes, eviction, sessions, states."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def listing_files(spark: SparkSession, path: str, schema: str, most: int = 1000) -> DataFrame:
    """Listing files as a stream; the checkpoint knows which were read."""
    return spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("maxFilesPerTrigger", most).csv(path)


def first_per_day(stream: DataFrame, keys: list[str], when: str, late: str = "2 days") -> DataFrame:
    """The first row of each key and day; later ones are dropped, state goes after ``late``."""
    return stream.withColumn("day", F.to_date(when)).withWatermark(when, late).dropDuplicatesWithinWatermark([*keys, "day"])


def daily(stream: DataFrame, keys: list[str], when: str, value: str, late: str = "180 days") -> DataFrame:
    """count, mean, low and high by day; rows over ``late`` behind are evicted."""
    w = F.window(when, "1 day").alias("window")
    return stream.withWatermark(when, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def sliding(stream: DataFrame, keys: list[str], when: str, value: str, length: str = "7 days", step: str = "1 day", late: str = "7 days") -> DataFrame:
    return stream.withWatermark(when, late).groupBy(*keys, F.window(when, length, step).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, keys: list[str], when: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows of a key that are at most ``gap`` apart form a session."""
    s = F.session_window(when, gap).alias("session")
    return stream.withWatermark(when, late).groupBy(*keys, s).agg(F.count(F.lit(1)).alias("n"))


def _seconds(length: str) -> float:
    n, unit = length.split()
    return dt.timedelta(**{unit.rstrip("s") + "s": float(n)}).total_seconds()


def risk_states(passes: DataFrame, key: str, when: str, challenges: str, soft: str, idle: str = "30 days") -> DataFrame:
    """``passes`` (one row for each of a key's passes) with ``state`` and ``reason`` after each, in the order of
    ``when``; equal times go by fewer challenges, then fewer soft signals.

    Fixed values: a challenge means Cooldown, three soft signals or more Elevated; a clean pass
    leads from Elevated to Normal and leaves the other states. All keys begin as Normal, and
    again after ``idle`` without a pass. So the last pass with a signal decides, and no row needs
    more than a running window. A pass without a time is left out."""
    order = [F.col(when), F.coalesce(challenges, F.lit(0)), F.coalesce(soft, F.lit(0))]
    running = Window.partitionBy(key).orderBy(*order)
    at = F.unix_micros(F.col(when).cast("timestamp"))
    rested = F.coalesce(at - F.lag(at).over(running) >= int(_seconds(idle) * 1_000_000), F.lit(False))
    known = passes.where(F.col(when).isNotNull()).withColumn("_rested", rested).withColumn("_run", F.count_if("_rested").over(running))
    w = Window.partitionBy(key, "_run").orderBy(*order)
    signal = F.when(F.coalesce(challenges, F.lit(0)) > 0, "hard_challenge_signal").when(F.coalesce(soft, F.lit(0)) >= 3, "soft_risk_cluster")
    last = F.last(signal, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(last == "hard_challenge_signal", "Cooldown").when(signal.isNotNull(), "Elevated").otherwise("Normal")
    calmed = signal.isNull() & (F.lag(signal).over(w) == "soft_risk_cluster")
    reason = F.coalesce(signal, F.when(calmed, "clean_pass_after_elevated"))
    return known.select(*passes.columns, state.alias("state"), reason.alias("reason"))


class _Ordered(StatefulProcessor):
    """Holds a key's passes until the watermark has passed them, then takes them in order."""

    def __init__(self, idle: float):
        self.idle = int(idle * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, challenges int, soft int")
        self.state = handle.getValueState("state", "state string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done = max(timerValues.getCurrentWatermarkInMs() * 1000, self.state.get()[1] if self.state.exists() else 0)
        new = [(r["_at"], r["_hard"], r["_soft"]) for r in rows if r["_at"] is not None and r["_at"] > done]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state, last = self.state.get() if self.state.exists() else ("Normal", None)
        out = []
        for at, hard, soft in due:
            if last is not None and at - last >= self.idle:
                state = "Normal"
            reason = "hard_challenge_signal" if hard > 0 else "soft_risk_cluster" if soft >= 3 else "clean_pass_after_elevated" if state == "Elevated" else None
            state = {"hard_challenge_signal": "Cooldown", "soft_risk_cluster": "Elevated", "clean_pass_after_elevated": "Normal"}.get(reason, state)
            last = at
            out.append(Row(_key=key[0], at=at, challenges=hard, soft=soft, state=state, reason=reason))
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        if last is not None:
            if last + self.idle <= now:  # whatever comes is as far from it
                self.state.clear()
            else:
                self.state.update((state, last))
                self.handle.registerTimer((last + self.idle) // 1000 + 1)
        return iter(out)

    def close(self) -> None:
        pass


def risk_stream(stream: DataFrame, key: str, when: str, challenges: str, soft: str, late: str = "1 day", idle: str = "30 days") -> DataFrame:
    """The states of ``risk_states`` over a stream: ``key, at, challenges, soft, state, reason`` for each pass, once
    the watermark, ``late`` behind the newest pass, has reached it.

    Rows may come in any order and in any batches within ``late``; later ones are dropped. A key
    without passes for ``idle`` loses its state and begins as Normal again. Needs the RocksDB
    state store."""
    kind = stream.schema[key].dataType.simpleString()
    counts = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(n) for c, n in ((challenges, "_hard"), (soft, "_soft"))]
    rows = stream.select(key, F.col(when).cast("timestamp").alias("_when"), F.unix_micros(F.col(when).cast("timestamp")).alias("_at"), *counts)
    schema = f"_key {kind}, at bigint, challenges int, soft int, state string, reason string"
    out = rows.withWatermark("_when", late).groupBy(key).transformWithState(_Ordered(_seconds(idle)), schema, "append", "EventTime")
    return out.select(F.col("_key").alias(key), F.timestamp_micros("at").alias("at"), "challenges", "soft", "state", "reason")


def collected(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into a table in memory (reports and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
