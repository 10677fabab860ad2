"""Event-time queries over a stream of event files, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_path


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with a watermark; times are zoned, as watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    glob = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return glob.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def finished(spark: SparkSession, df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns its result, read back from a table of files.

    In complete mode each batch replaces the table, in append mode batches are added, and in update mode the last row of
    each of `keys` counts. A batch that runs again after a failure overwrites its own folder, so nothing is counted twice.
    The stream's checkpoint and the table are in the folder that the cluster shares.
    """
    top = shared_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{top}/out")
    if mode == "update":
        others = [c for c in df.columns if c not in keys]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, "_last.*").select(df.columns)
    return out.select(df.columns)


def daily(events: DataFrame) -> DataFrame:
    """Count and sum for each day and kind of event."""
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, as far as the watermark remembers."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def followed(left: DataFrame, right: DataFrame, *, by: str, seconds: int) -> DataFrame:
    """Joins two streams: pairs of a key whose right time is after the left one by at most so many seconds.

    left has left_ts, right right_ts, both with watermarks, so rows that can find no more partners leave the state.
    """
    on = (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col("right_ts") > F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.alias("l").join(right.alias("r"), on)


def longest_runs(events: DataFrame) -> DataFrame:
    """For each user the number of events and the longest run of growing values, by state of our own kept from batch to batch.

    Rows are sorted within a batch only: a row that comes in a later batch than one behind it in time counts as if it were
    newer. `timed_sessions` shows state that does not depend on the order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, now, best, last = state.get if state.exists else (0, 0, 0, float("-inf"))
        for x in pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"]:
            n, now, last = n + 1, now + 1 if x > last else 1, x
            best = max(best, now)
        state.update((n, now, best, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "longest": [best]})

    rows = events.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, longest long", "n long, now long, best long, last double", "update", GroupStateTimeout.NoTimeout)


# --- streams that arrive in several batches -------------------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_arrivals(spark: SparkSession, rows: DataFrame, arrival: str, build: Callable[[DataFrame], DataFrame], *, mode: str, time: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over rows that arrive in several batches, the numbers in `arrival` in order, and returns its result.

    For each number its rows are added to a folder, and the stream is started anew from its checkpoint and run over what
    has come, so all it knows of earlier batches is its state, which RocksDB keeps in the shared folder. build: from the
    stream of rows (times zoned, no watermark yet) to the streaming result. The result is read as `finished` does.
    """
    top = shared_path(spark, "arrivals")
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    numbers = [r[0] for r in rows.select(arrival).distinct().orderBy(arrival).collect()]  # few, by the caller's rule
    if not numbers:
        raise ValueError("nothing arrives, so there is nothing to start a stream for")
    rows.write.partitionBy(arrival).parquet(f"{top}/rows")
    schema = rows.drop(arrival).schema
    conf, name = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        for n in numbers:
            spark.read.schema(schema).parquet(f"{top}/rows/{arrival}={n}").write.mode("append").parquet(f"{top}/in")
            source = spark.readStream.schema(schema).parquet(f"{top}/in")
            _run(build(source), mode, top)
    finally:
        conf.set(name, old) if old is not None else conf.unset(name)
    return _result(spark, build(spark.readStream.schema(schema).parquet(f"{top}/in")), mode, top, keys)


def _run(df: DataFrame, mode: str, top: str) -> None:
    """One start of a stream over all that has come; each of its batches has a folder that a second try overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={0 if mode == 'complete' else number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _result(spark: SparkSession, df: DataFrame, mode: str, top: str, keys: list[str] | None) -> DataFrame:
    """What a stream has written. In update mode the last row of each key counts."""
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{top}/out")
    if mode == "update":
        others = [c for c in df.columns if c not in keys]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, "_last.*").select(df.columns)
    return out.select(df.columns)


def timely(events: DataFrame, *, delay: str, width: str, by: list[str], value: str) -> DataFrame:
    """Count and sum for each window and key of the rows that come before the watermark has passed their window's end."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("bucket"), *by, "n", "total")


def timed_sessions(events: DataFrame, *, delay: str, gap_seconds: int, buckets: int = 1024) -> DataFrame:
    """user_id, began, ended, n and total of each user's sessions, by state and event-time timers of our own.

    Users are dealt into buckets, and state is a bucket's open sessions; so calls and timers are as many as buckets, not as
    sessions or users. Rows may come in any order within the watermark: each opens a session, prolongs one, or
    joins two that it lies between. A session that ended `gap_seconds` before the watermark can get no more rows: the
    bucket's timer, set for the first of them, goes off, and all that the watermark has passed are given out and dropped. Rows
    behind the watermark are dropped by Spark.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names = ["user", "none", "began", "ended", "n", "total"]
    gap = gap_seconds * 1_000_000

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # Of each open session its user (none: null), began and ended in microseconds, rows and sum, as lists.
            self.open = handle.getValueState("open", "user array<long>, none array<boolean>, began array<long>, ended array<long>, n array<long>, total array<double>")

        def held(self) -> pd.DataFrame | None:
            return pd.DataFrame(dict(zip(names, (list(x) for x in self.open.get()), strict=True))) if self.open.exists() else None

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.held()
            timer = None if held is None else self.due(held)
            for batch in rows:
                new = pd.DataFrame({"user": batch["user"], "none": batch["none"], "began": batch["us"], "ended": batch["us"], "n": 1, "total": batch["value"]})
                held = self.merged(new if held is None else pd.concat([held, new], ignore_index=True))
            self.keep(held, timer)
            yield from ()

        def merged(self, x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["none", "user", "began", "ended"], kind="stable", ignore_index=True)
            last = x.groupby(["none", "user"])["ended"].cummax().shift(fill_value=0)
            other = (x["user"] != x["user"].shift()) | (x["none"] != x["none"].shift())
            return x.groupby((other | (x["began"] - last >= gap)).cumsum()).agg({"user": "first", "none": "first", "began": "min", "ended": "max", "n": "sum", "total": "sum"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            held = self.held()
            if held is None:
                return
            over = held["ended"] + gap <= now * 1000
            self.keep(held[~over], None)
            done = held[over]
            if len(done):
                at = lambda c: pd.to_datetime(done[c], unit="us", utc=True)
                yield pd.DataFrame({"user_id": done["user"].astype("Int64").mask(done["none"].astype(bool)), "began": at("began"), "ended": at("ended"), "n": done["n"], "total": done["total"]})

        def keep(self, held: pd.DataFrame, timer: int | None) -> None:
            """timer: the one that is set."""
            due = self.due(held) if len(held) else None
            if len(held):
                self.open.update(tuple(held[c].tolist() for c in names))
            else:
                self.open.clear()
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)

        def due(self, held: pd.DataFrame) -> int:
            """When the first ends, in milliseconds, rounded up: no sooner than the gap is over."""
            return -(-(int(held["ended"].min()) + gap) // 1000)

        def close(self) -> None:
            pass

    rows = events.withWatermark("ts", delay).select("ts", F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNull().alias("none"), F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(Sessions(), "user_id long, began timestamp, ended timestamp, n long, total double", "Append", "EventTime")
