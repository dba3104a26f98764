"""Structured Streaming queries over events, run to the end of their input and given as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sources.shared import new_path

#: How long after the latest time seen rows still count.
LATE = "10 minutes"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def stream(spark: SparkSession, folder: str, name: str, files_at_once: int = 16) -> DataFrame:
    """A stream of a table's files. Event times are made timestamps of the session's zone, which watermarks need."""
    path = f"{folder.rstrip('/')}/{name}.parque[t]"  # as a pattern the path may be one file
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run(rows: DataFrame, mode: str, name: str) -> tuple[DataFrame, list[dict]]:
    """Runs a stream over all there is, into Parquet files of the shared folder, a folder for each micro-batch. The
    result has the stream's columns and batch, the micro-batch's number; nothing comes to the driver. A micro-batch that
    runs again replaces its own files. Beside it, what Spark tells of the last micro-batches."""
    spark, schema = rows.sparkSession, rows.schema
    path = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = rows.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    done = writer.start()
    done.awaitTermination()
    kind = StructType([*schema.fields, StructField("batch", LongType())])
    found = spark.createDataFrame([], kind)
    try:
        found = spark.read.schema(kind).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except AnalysisException as missing:  # a stream without rows has no micro-batch
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return found, [json.loads(p.json) for p in done.recentProgress]


def written(rows: DataFrame, mode: str, name: str) -> DataFrame:
    """The table of run()."""
    return run(rows, mode, name)[0]


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Inside, streams of the session keep their state in RocksDB, which transformWithState needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts and sums by event type and window. Rows of windows that ended before the watermark, `late` before the
    latest time seen in earlier micro-batches, are dropped by Spark; so is a window's state once it has ended then."""
    made = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return made.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """In append mode: each window once, when the watermark passes its end; windows still open at the end of the input
    aren't given."""
    return written(tumbling(stream(spark, folder, "events")), "append", "tumbling").drop("batch")


class Totals(StatefulProcessor):
    """Events and value of each user so far. The state is one row for each user that ever was, whatever the number of
    events: totals over all time have nothing to forget. stateful.visits is the form whose users leave."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total = self.so_far.get() if self.so_far.exists() else (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.so_far.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def stream_users(spark: SparkSession, folder: str) -> DataFrame:
    """Events and value of each user, of the last micro-batch that had any of theirs."""
    rows = stream(spark, folder, "events").select("user_id", "value")
    with rocks_db(spark):
        out = rows.groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long, total double", "Update", "None")
        changes = written(out, "update", "users")
    return changes.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))


QUERIES |= {"stream_tumbling": stream_tumbling, "stream_users": stream_users}
ORACLE_SQL |= {
    "stream_tumbling": f"SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {LATE}",
    "stream_users": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id",
}
