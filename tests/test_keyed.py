"""Keyed state: incidents and the breaker against plain rules, in any order of arrival and over a restart."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from skein.streaming import bus, keyed

START = datetime(2024, 5, 1, tzinfo=UTC)
CALLS = "user_id string, event_id long, ts timestamp, failed boolean"


def run(spark, stream, folder, mode="append"):
    """One run until the input is drained; the sink keeps each batch once."""

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/run={number}")

    with keyed.state_store(spark):
        stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_incidents_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(("incident_intake", "incident_resolved", "query_executed")), f"r{rng.randrange(6)}", START + timedelta(seconds=rng.randrange(60)), str(i)) for i in range(120)]
    want = {}
    for kind, repo, at, i in rows:
        if kind != "query_executed":
            want[repo] = max(want.get(repo, (START - timedelta(days=1), "", "")), (at, kind, f'{{"id":"{i}"}}'))
    rng.shuffle(rows)
    folder = str(tmp_path / "bus")
    for part in (rows[:70], rows[70:]):
        df = spark.createDataFrame(part, "k string, repo string, at timestamp, i string").repartition(5)
        bus.emit(bus.to_event(df, F.col("k"), F.col("repo"), F.col("at"), F.create_map(F.lit("id"), F.col("i"))), folder)
        changes = run(spark, keyed.incidents(bus.subscribe(spark, folder, per_trigger=2)), tmp_path, "update")
    got = {r["repo_id"]: (r["since"].timestamp(), r["snapshot"]) for r in keyed.open_incidents(changes).collect()}
    assert got == {repo: (at.timestamp(), data) for repo, (at, kind, data) in want.items() if kind == "incident_intake"}


def plain_breaker(calls, most, reset_s):
    """calls: (user, id, second, failed). States after each call, and where a pause ends before another call or the end."""
    out, now = [], {}
    for user, id_, second, failed in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        state, failures, last = now.get(user, ("CLOSED", 0, 0))
        if state == "OPEN" and second - last > reset_s:
            state = "HALF_OPEN"
        refused = state == "OPEN"
        if not refused and failed:
            failures, last = failures + 1, second
            state = "OPEN" if failures >= most else state
        elif not refused and state == "HALF_OPEN":
            state, failures = "CLOSED", 0
        now[user] = state, failures, last
        out.append((user, id_, state, refused))
    return sorted(out)


def random_calls(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("ab"), i, int(rng.choice((i * 7, i * 7, i * 7 + rng.randrange(200)))), rng.random() < 0.5) for i in range(n)]


def test_breaker_equals_the_plain_rule_over_a_restart(spark, tmp_path):
    calls = random_calls(150, 2)
    rows = [(u, i, START + timedelta(seconds=s), f) for u, i, s, f in calls]
    end = (None, None, START + timedelta(days=2), False)
    folder = str(tmp_path / "calls")
    rows.sort(key=lambda r: r[1])
    for part in (rows[:60], rows[60:], [end]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(folder)
        out = run(spark, keyed.breaker(stream, most=3, reset_s=60), tmp_path)
    got = [(r["key"], r["id"], r["state"], r["refused"]) for r in out.where("id IS NOT NULL").collect()]
    assert sorted(got) == plain_breaker(calls, 3, 60)
    ends = out.where("id IS NULL AND key <> ''").collect()
    assert ends and all(r["state"] == "HALF_OPEN" for r in ends)


def test_query_equals_the_batch_rule(spark, sf):
    from skein.plans.registry import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id % 20 AS u", "unix_timestamp(cast(ts AS timestamp)) AS s", "event_type = 'error' AS f").collect()
    want = plain_breaker([(r["u"], r["event_id"], r["s"], r["f"]) for r in events], 3, 3600)
    got = [(r["user_id"], r["event_id"], r["state"], r["refused"]) for r in QUERIES["stream_breaker"](spark, sf).where("event_id IS NOT NULL").collect()]
    assert sorted(got) == want
