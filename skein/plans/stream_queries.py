"""Streaming queries: each runs a stream over a table's files until it is drained and returns the sink's rows.

Complete and update results equal the batch SQL; in append mode windows that the watermark has not closed stay back, so
those queries read the sink of a stream in complete mode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.scratch import shared_folder
from skein.streaming import bus, keyed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    table = f"{sf}/events.parquet"
    schema = spark.read.parquet(table).schema
    return bus.with_event_time(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """The sink's rows; batches of a stream in complete mode replace each other."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{folder}/out")
        else:  # one action only, since each would run the state's step again
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")  # once for each batch, also when it is repeated

    started = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(stream.columns)


@query("stream_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(bus.windowed_counts(_events(spark, sf), "1 hour"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_counts", "WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, range(0, 2) r(i)) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(bus.windowed_counts(_events(spark, sf), "1 hour", "30 minutes"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, nr")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(bus.sessions(_events(spark, sf), "12 hours"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_unique_events", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_unique_events(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(bus.unique_events(_events(spark, sf)), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_KIND = "CASE event_type WHEN 'error' THEN 'incident_intake' WHEN 'signup' THEN 'incident_resolved' WHEN 'purchase' THEN 'github_push' ELSE 'query_executed' END"


def _bus(spark: SparkSession, sf: str) -> str:
    """The events as a bus, with a malformed line."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("kind", F.expr(_KIND))
    folder = f"{shared_folder(spark)}/bus-{uuid.uuid4().hex}"
    bus.emit(bus.to_event(events, F.col("kind"), F.col("user_id") % 50, F.col("ts"), F.create_map(F.lit("id"), F.col("event_id").cast("string"))), folder)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(folder)
    return folder


@query("bus_subscription", f"SELECT {_KIND} AS event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def bus_subscription(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(bus.subscribe(spark, _bus(spark, sf), ("incident_intake", "github_push")), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("bus_reindex", "SELECT CAST(user_id % 50 AS VARCHAR) AS repo_id, 'index_started' AS event_type, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def bus_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(bus.push_to_reindex(bus.subscribe(spark, _bus(spark, sf))), "append").groupBy("repo_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("open_incidents", f"WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS repo_id, {_KIND} AS kind, ts, event_id FROM events WHERE event_type IN ('error', 'signup')), l AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, kind DESC, event_id DESC) AS r FROM e) SELECT repo_id, ts AS since FROM l WHERE r = 1 AND kind = 'incident_intake'")
def open_incidents(spark: SparkSession, sf: str) -> DataFrame:
    with keyed.state_store(spark):
        changes = _drained(keyed.incidents(bus.subscribe(spark, _bus(spark, sf), per_trigger=4)), "update")
    return keyed.open_incidents(changes).select("repo_id", F.col("since").cast("timestamp_ntz").alias("since"))


@query("stream_breaker")
def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """The breaker by timers; tests hold it against the plain rule. A late event of no user moves the watermark past all others."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    calls = events.select(F.col("event_id"), (F.col("user_id") % 20).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    folder = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    calls.write.parquet(folder)
    end = calls.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(calls.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(False).alias("failed"))
    end.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(calls.schema).parquet(folder)
    with keyed.state_store(spark):
        out = _drained(keyed.breaker(stream, most=3, reset_s=3600), "append")
    return out.where("key <> ''").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), F.col("at").cast("timestamp_ntz").alias("at"), "state", "refused")
