"""The event bus on Structured Streaming: files in, typed handlers, windows, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: event types
EVENT_TYPES = ("index_started", "index_complete", "index_failed", "index_progress", "query_executed", "query_failed", "incident_intake", "incident_resolved", "repo_added", "repo_updated", "repo_removed", "github_push", "github_pr")
EVENT = "event_type string, repo_id string, timestamp timestamp, data map<string,string>, source string, correlation_id string"
LATE = "10 minutes"


def to_event(rows: DataFrame, event_type, repo_id, timestamp, data=None, source: str = "skein", correlation_id=None) -> DataFrame:
    """Rows in the event schema."""
    none = F.lit(None).cast("string")
    return rows.select(event_type.alias("event_type"), repo_id.cast("string").alias("repo_id"), timestamp.cast("timestamp").alias("timestamp"), (data if data is not None else F.lit(None).cast("map<string,string>")).alias("data"), F.lit(source).alias("source"), (correlation_id if correlation_id is not None else none).alias("correlation_id"))


def emit(events: DataFrame, folder: str) -> None:
    """Appends a batch of events to the bus, a folder of JSON lines."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)


def subscribe(spark: SparkSession, folder: str, types: tuple[str, ...] | None = None, per_trigger: int | None = None) -> DataFrame:
    """A stream of the bus; malformed lines and events of other types are skipped."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    parsed = reader.load(folder).select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e.event_type IS NOT NULL").select("e.*")
    return parsed.where(F.col("event_type").isin(*(types or EVENT_TYPES)))


class Dispatcher:
    """Handlers by event type for ``foreachBatch``: each gets its type's rows, and one that fails stops no other."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[DataFrame, int], None]]] = {}
        self.failures: list[tuple[int, str, str]] = []

    def on(self, event_type: str, handler: Callable[[DataFrame, int], None]) -> None:
        if event_type not in EVENT_TYPES:
            raise ValueError(f"unknown event type {event_type}")
        self.handlers.setdefault(event_type, []).append(handler)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for event_type, handlers in self.handlers.items():
            for handler in handlers:
                try:
                    handler(batch.where(F.col("event_type") == event_type), batch_id)
                except Exception as e:  # a handler's fault stays with it
                    self.failures.append((batch_id, event_type, str(e)))
        batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_to_reindex(batch: DataFrame) -> DataFrame:
    """GitHub pushes as the index_started events that they cause."""
    return to_event(batch.where("event_type = 'github_push'"), F.lit("index_started"), F.col("repo_id"), F.col("timestamp"), F.create_map(F.lit("scope"), F.lit("incremental")), correlation_id=F.col("correlation_id"))


def with_event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Time zone-less times as instants, with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE)


def windowed_counts(stream: DataFrame, width: str = "5 minutes", slide: str | None = None, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    return stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def unique_events(stream: DataFrame, id_col: str = "event_id") -> DataFrame:
    return stream.dropDuplicatesWithinWatermark([id_col])


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
