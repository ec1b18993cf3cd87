"""Streams: the order-dependent operators on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lotwerk.operators.history import replace_affected, starts_of
from lotwerk.session import cut, shared_folder
from lotwerk.sources.versions import bucket_of


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table's parquet as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", True).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per event type and event-time window; rows later than the watermark are left out of closed windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user: events no further than gap apart."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


class OnceOnly(StatefulProcessor):
    """The first event of a subject and attribute is stored, later ones refer to it; within a batch order is by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", T.StructType([T.StructField("id", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            if not self.first.exists():
                self.first.update((int(pdf["event_id"].iloc[0]),))
            source = self.first.get()[0]
            yield pd.DataFrame({"event_id": pdf["event_id"], "art": ["gespeichert" if e == source else "verwendet" for e in pdf["event_id"]], "quelle": source})

    def close(self) -> None:
        pass


def once_only(events: DataFrame) -> DataFrame:
    """(event_id, art, quelle): the once-only ledger with its state kept per subject and attribute.

    The state lies in RocksDB: this sets the session's state store for the streams started from here on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = events.select("event_id", "user_id", "event_type", "ts")
    return kept.groupBy("user_id", "event_type").transformWithStateInPandas(OnceOnly(), "event_id long, art string, quelle long", "append", "none")


def keep_history(batches: DataFrame, raw: str, registry: DataFrame, name: str):
    """A foreachBatch writer of events into the published history name: each batch rebuilds only the chains it touches.

    raw is the folder with all events so far, in buckets of entities. A batch is appended there under its id first, so
    that a repeated batch overwrites itself and the result is the same; then only the buckets it touches are read, and
    their part of the history is replaced in one step.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket_of("kennung")).write.mode("overwrite").partitionBy("bucket").parquet(f"{raw}/batch={batch_id}")
        new = cut(batch)
        hit = [r[0] for r in new.select(bucket_of("kennung")).distinct().collect()]  # as many as there are buckets, at most
        events = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new.schema)}, batch int, bucket int").parquet(raw)
        replace_affected(name, new, events.filter(F.col("bucket").isin(hit)).drop("batch", "bucket"), starts_of(registry))

    return batches.writeStream.foreachBatch(one)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream has given when all its input now there has been read, as a table in the shared folder.

    Rows are appended once they are final: windows and sessions when the watermark has passed their end, so that state is
    dropped with them. What the watermark has not passed yet is still open and not given.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/lotwerk_streams/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts per event type of the days that are closed, streamed to the end of the table."""
    out = drained(windowed_counts(event_stream(spark, folder)))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("tag"), "event_type", "n", F.col("v").cast("double").alias("v"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in closed windows of two days every day."""
    out = drained(windowed_counts(event_stream(spark, folder), "2 days", "1 day"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("tag"), "event_type", "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sessions per user."""
    out = drained(sessions(event_stream(spark, folder)))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("anfang"), "n")


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrive more than once, kept once within the watermark: the table streamed with itself."""
    twice = event_stream(spark, folder).union(event_stream(spark, folder)).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return drained(twice.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])).select("event_id")


QUERIES = {"stream_dedup": stream_dedup, "stream_windows": stream_windows, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions}
#: The watermark at the end of the table.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"
SQL = {
    "stream_dedup": "SELECT DISTINCT event_id FROM events",
    "stream_windows": f"SELECT strftime(ts, '%Y-%m-%d') tag, event_type, count(*) n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) v FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK} GROUP BY ALL",
    "stream_sliding": f"SELECT strftime(t, '%Y-%m-%d') tag, event_type, count(*) n FROM (SELECT event_type, unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) t FROM events) WHERE t + INTERVAL 2 DAY <= {_MARK} GROUP BY ALL",
    "stream_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END neu FROM events), s AS (SELECT user_id, ts, sum(neu) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, min(ts) anfang, count(*) n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {_MARK}""",
}
