"""Windows over time: rate limits, rates, quantiles from histograms, alerts, concurrency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.scratch import cut

# --- fixed values ---------------------------------------------------------------------------------------------------
#: tier: requests per hour, per minute, burst in 10 seconds
TIERS = {"free": (100, 10, 5), "developer": (1000, 50, 20), "team": (10000, 200, 100), "enterprise": (100000, 2000, 500)}
MULTIPLIERS = {"search": 0.5, "resolve-stack-trace": 0.7, "dependency-graph": 0.8, "blast-radius": 0.5, "file": 1.0, "commit-diff": 0.8, "batch": 0.3, "health": 10.0}
WINDOWS = (3600, 60, 10)
MINUTE_LIMIT, BURST_LIMIT, BURST_SECONDS = 500, 1000, 10
# --------------------------------------------------------------------------------------------------------------------


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970, of either timestamp type."""
    return F.unix_timestamp(ts.cast("timestamp"))


def sliding_counts(requests: DataFrame, window: int, keys: tuple[str, ...] = ("user_id", "endpoint"), ts: str = "ts") -> DataFrame:
    """Requests in the last ``window`` seconds up to each one, and when the oldest of them leaves.

    Each frame begins with its key's first request and only grows, since a frame that moves is counted anew for every row: what has left is taken from
    what has come, and the oldest request is the one that follows the last that has left. Requests without a time count among themselves.
    """
    at = requests.withColumn("second", seconds(F.col(ts))).withColumn("_timeless", F.isnull("second"))
    order = Window.partitionBy(*keys, "_timeless").orderBy("second")
    come, left = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -window)
    gone = F.when(F.col("_timeless"), 0).otherwise(F.count(F.lit(1)).over(left))
    at = at.withColumns({"in_window": F.count(F.lit(1)).over(come) - gone, "_first": F.min("second").over(come), "_next": F.lead("second").over(order)})
    return at.withColumn("reset_at", F.coalesce(F.max("_next").over(left), F.col("_first")) + window).drop("_timeless", "_first", "_next")


def admit(requests: DataFrame, tier: str = "free", keys: tuple[str, str] = ("user_id", "endpoint"), ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The verdict on each request: allowed, or the first of hour, minute, burst that is full.

    Only allowed requests count later, so each user's requests are folded in order; hour and minute are per endpoint with
    its multiplier, burst is per user. A user's requests arrive sorted and stream through; of them the last hour is held.
    """
    user, endpoint = keys
    hour, minute, burst = TIERS[tier]
    rows = requests.select(F.col(id_col), F.col(user).alias("user_id"), F.col(endpoint).alias("endpoint"), seconds(F.col(ts)).alias("second"))

    def fold(batches):
        from collections import deque

        now_user, held = None, {}
        for pdf in batches:
            out = []
            for user_id, name, second in zip(pdf["user_id"], pdf["endpoint"], pdf["second"], strict=True):
                if user_id != now_user:
                    now_user, held = user_id, {}
                factor = MULTIPLIERS.get(name, 1.0)
                verdict = "allowed"
                for what, key, width, most in (("hour", name, 3600, int(hour * factor)), ("minute", name, 60, int(minute * factor)), ("burst", None, 10, burst)):
                    times = held.setdefault((what, key), deque())
                    while times and times[0] <= second - width:
                        times.popleft()
                    if len(times) >= most:
                        verdict = what
                        break
                if verdict == "allowed":
                    for key in (("hour", name), ("minute", name), ("burst", None)):
                        held.setdefault(key, deque()).append(second)
                out.append(verdict)
            yield pd.DataFrame({id_col: pdf[id_col], "verdict": out})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.repartition("user_id").sortWithinPartitions("user_id", "second", id_col).mapInPandas(fold, f"{id_col} {kind}, verdict string")


def tumbling_limit(requests: DataFrame, per_minute: int = MINUTE_LIMIT, burst: int = BURST_LIMIT, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Verdicts by fixed buckets: burst first, and what the burst rejects does not count for the minute."""
    at = requests.withColumn("second", seconds(F.col(ts)))
    nth = F.row_number().over(Window.partitionBy(key, F.floor(F.col("second") / BURST_SECONDS)).orderBy("second", id_col))
    at = at.withColumn("burst_full", nth > burst)
    again = F.row_number().over(Window.partitionBy(key, "burst_full", F.floor(F.col("second") / 60)).orderBy("second", id_col))
    return at.withColumn("verdict", F.when(F.col("burst_full"), "burst").when(again > per_minute, "minute").otherwise("allowed")).select(id_col, key, "verdict")


def bucket_usage(requests: DataFrame, width: str = "1 minute", limit: int = MINUTE_LIMIT, key: str = "user_id", ts: str = "ts") -> DataFrame:
    counted = requests.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("used"))
    return counted.select(key, F.col("w.start").alias("bucket"), "used", F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"))


def concurrency(spans: DataFrame, keys: tuple[str, ...] = ("user_id",), limit: int = 5) -> DataFrame:
    """spans: (.., start, end). In-flight requests at each start; at one instant ends come before starts."""
    started = spans.select(*keys, F.col("start").alias("at"), F.lit(1).alias("step"))
    ended = spans.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("step"))
    frame = Window.partitionBy(*keys).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    running = started.union(ended).withColumn("in_flight", F.sum("step").over(frame)).where("step = 1")
    return running.groupBy(*keys).agg(F.max("in_flight").alias("peak"), F.count_if(F.col("in_flight") > limit).alias("over_limit"))


def event_rate(events: DataFrame, width_s: int, keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Events per second in tumbling windows."""
    return events.groupBy(*keys, F.window(ts, f"{width_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("bucket"), (F.col("n") / width_s).alias("rate"))


def counter_rate(samples: DataFrame, keys: tuple[str, ...], ts: str = "ts", value: str = "value") -> DataFrame:
    """Per-second increase of a cumulative counter between its samples; after a reset the value itself is the increase."""
    order = Window.partitionBy(*keys).orderBy(ts)
    before, since = F.lag(value).over(order), seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(order)
    rise = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.withColumn("rate", F.try_divide(rise, since)).where(F.col("rate").isNotNull())


def histogram_quantile(observations: DataFrame, edges: tuple[float, ...], quantile: float, keys: tuple = (), value: str = "value") -> DataFrame:
    """The quantile interpolated in cumulative buckets (le edges, and infinity). Above the last edge it is that edge."""
    counts = [F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    c = observations.groupBy(*keys).agg(F.count_if(F.col(value).isNotNull()).alias("n"), *counts).where("n > 0")
    rank = quantile * F.col("n")
    out = F.lit(float(edges[-1]))
    for i in range(len(edges) - 1, -1, -1):
        low, below = (float(edges[i - 1]), F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inner = low + (edges[i] - low) * F.try_divide(rank - below, F.col(f"b{i}") - below)
        if i == 0 and edges[0] <= 0:
            inner = F.lit(float(edges[0]))
        out = F.when(F.col(f"b{i}") >= rank, inner).otherwise(out)
    names = [x if isinstance(x, str) else c.columns[j] for j, x in enumerate(keys)]
    return c.select(*names, "n", out.alias("quantile"))


def ratio(events: DataFrame, hit: Column, miss: Column, width_s: int, ts: str = "ts") -> DataFrame:
    """Hits among hits and misses per window, 0 without any."""
    h, m = F.count_if(hit), F.count_if(miss)
    return events.groupBy(F.window(ts, f"{width_s} seconds").alias("w")).agg(F.coalesce(F.try_divide(h, h + m), F.lit(0.0)).alias("ratio")).select(F.col("w.start").alias("bucket"), "ratio")


def firing(samples: DataFrame, condition: Column, hold_s: int, keys: tuple[str, ...] = (), ts: str = "bucket") -> DataFrame:
    """Spans over which a condition held without a break for at least ``hold_s`` seconds: islands of the sample order."""
    whole, held = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys, "holds").orderBy(ts)
    marked = samples.withColumn("holds", F.coalesce(condition, F.lit(False)))
    marked = marked.withColumn("island", F.row_number().over(whole) - F.row_number().over(held)).where("holds")
    spans = marked.groupBy(*keys, "island").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    return spans.where(seconds(F.col("until")) - seconds(F.col("since")) >= hold_s).drop("island")


def nearest_rank(values: DataFrame, quantiles: tuple[float, ...], value: str = "value") -> DataFrame:
    """Sorted values' element int(n * q), from 0: equal values are counted first, then placed in ranges of the values.

    Each range's count tells where its values begin, so every wanted place lies in one range, and only that range is put in order.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counted.repartitionByRange(value).withColumn("part", F.spark_partition_id()))  # a count of each part and its rows must see the same parts
    sizes = ranged.groupBy("part").agg(F.sum("c").alias("size"))
    begins = sizes.withColumn("begin", F.sum("size").over(Window.orderBy("part")) - F.col("size"))  # a row for each partition
    total = ranged.agg(F.sum("c").alias("n"))
    wanted = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("k")) for q in quantiles))).alias("w")
    targets = total.select(wanted).select("w.q", "w.k")
    found = begins.join(F.broadcast(targets), (F.col("k") >= F.col("begin")) & (F.col("k") < F.col("begin") + F.col("size"))).select("part", "q", (F.col("k") - F.col("begin")).alias("k"))
    here = ranged.join(F.broadcast(found.select("part").distinct()), "part")  # no more rows than quantiles
    upto = here.withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    met = upto.join(F.broadcast(found), "part").where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
    return met.select(F.col("q").alias("quantile"), F.col(value).alias("value"))


def usage_totals(usage: DataFrame, limit: int, user: str = "user_id") -> DataFrame:
    """usage: (user, endpoint, used)."""
    return usage.groupBy(user).agg(F.sum("used").alias("used")).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used")))


def breaker_states(calls: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", failed: str = "failed", most: int = 5, reset_s: int = 60) -> DataFrame:
    """The circuit breaker's state after each call, per key in order; calls while it is open are refused."""
    rows = calls.select(F.col(id_col), F.col(key), seconds(F.col(ts)).alias("second"), F.col(failed).alias("failed"))

    def fold(batches):
        now, state, failures, last = None, "CLOSED", 0, 0
        for pdf in batches:
            out = []
            for k, second, bad in zip(pdf[key], pdf["second"], pdf["failed"], strict=True):
                if k != now:
                    now, state, failures, last = k, "CLOSED", 0, 0
                if state == "OPEN" and second - last > reset_s:
                    state = "HALF_OPEN"
                if state == "OPEN":
                    out.append(("OPEN", True))
                    continue
                if bad:
                    failures, last = failures + 1, second
                    state = "OPEN" if failures >= most else state
                elif state == "HALF_OPEN":
                    state, failures = "CLOSED", 0
                out.append((state, False))
            yield pd.DataFrame({id_col: pdf[id_col], "state": [s for s, _ in out], "refused": [r for _, r in out]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "second", id_col).mapInPandas(fold, f"{id_col} {kind}, state string, refused boolean")
