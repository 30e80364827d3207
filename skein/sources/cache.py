"""The cache as tables: what a log of operations leaves in it, hits by namespace, prewarming, flushing, sealed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations that store a value, and all that a key can have.
STORING = ("set", "prewarm")
OPERATIONS = (*STORING, "get", "delete")


def _seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def _ttl(ttl_s: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in ttl_s.items() for x in kv)) if ttl_s else F.create_map().cast("map<string,int>")


def replay(log: DataFrame, ttl_s: dict[str, int]) -> DataFrame:
    """log: (namespace, key, op, value, at, seq). Each operation on a key with ``generation`` and what the cache held before it: ``held``
    (op, at, value), ``hit``.

    ``flush`` empties a namespace. An operation's generation is the number of its namespace's flushes before it: those of earlier hours, by a
    running sum over hours, and those of its own hour, by a running count over its rows. So neither a row nor a task holds the
    flushes, and keys are followed apart from each other, in order of time and seq. A namespace without a time to
    live keeps entries forever.
    """
    order = F.struct(_seconds(F.col("at")).alias("t"), F.col("seq").alias("s"))
    flush = (F.col("op") == "flush").cast("int")
    rows = log.where(F.col("op").isin(*OPERATIONS, "flush")).withColumn("o", order).withColumn("hour", F.floor(F.col("o.t") / 3600))
    earlier = Window.partitionBy("namespace").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("namespace", "hour").agg(F.sum(flush).alias("n")).select(F.col("namespace").alias("of"), F.col("hour").alias("at_hour"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("namespace", "hour").orderBy("o", flush).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum(flush).over(within)).where(F.col("op") != "flush")
    rows = rows.join(hours, F.col("namespace").eqNullSafe(F.col("of")) & F.col("hour").eqNullSafe(F.col("at_hour")))
    rows = rows.withColumn("generation", F.when(F.col("namespace").isNull(), 0).otherwise(F.col("earlier") + F.col("within")).cast("int"))
    before = Window.partitionBy("namespace", "key", "generation").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("op") != "get", F.struct("op", "at", "value"))
    rows = rows.withColumn("held", F.last(written, ignorenulls=True).over(before))
    fresh = F.coalesce(_seconds(F.col("at")) - _seconds(F.col("held.at")) < F.try_element_at(_ttl(ttl_s), F.col("namespace")), F.lit(True))
    hit = F.coalesce(F.col("held.op").isin(*STORING), F.lit(False)) & fresh
    return rows.withColumn("hit", hit).drop("o", "hour", "within", "of", "at_hour", "earlier")


def entries(log: DataFrame, ttl_s: dict[str, int], as_of: Column) -> DataFrame:
    """(namespace, key, value, written_at): what is alive after the log, at a time: each key's last writing operation, if it stored a value
    that is still fresh and no flush came since."""
    order = F.struct(_seconds(F.col("at")).alias("t"), F.col("seq").alias("s"))
    now = F.struct(_seconds(as_of.cast(log.schema["at"].dataType)).alias("t"), F.lit(2**62).alias("s"))
    past = log.withColumn("o", order).where(F.col("o") < now)
    written = past.where(F.col("op").isin(*OPERATIONS) & (F.col("op") != "get") & F.col("key").isNotNull())
    last = written.groupBy("namespace", "key").agg(F.max_by(F.struct("o", "op", "at", "value"), "o").alias("held"))
    flushed = past.where("op = 'flush'").groupBy("namespace").agg(F.max("o").alias("flushed"))
    kept = last.join(flushed, "namespace", "left").where(F.col("held.op").isin(*STORING) & (F.col("flushed").isNull() | (F.col("flushed") < F.col("held.o"))))
    fresh = F.coalesce(_seconds(as_of) - _seconds(F.col("held.at")) < F.try_element_at(_ttl(ttl_s), F.col("namespace")), F.lit(True))
    return kept.where(fresh).select("namespace", "key", F.col("held.value").alias("value"), F.col("held.at").alias("written_at"))


def statistics(log: DataFrame, ttl_s: dict[str, int], as_of: Column) -> DataFrame:
    """By namespace: gets, hits, hit_rate, stored (sets and prewarms), flushes, live entries at a time."""
    done = replay(log, ttl_s)
    get, n = F.col("op") == "get", F.count(F.lit(1))
    by = done.groupBy("namespace").agg(F.count_if(get).alias("gets"), F.count_if(get & F.col("hit")).alias("hits"), F.count_if(F.col("op").isin(*STORING)).alias("stored"))
    flushed = log.where("op = 'flush'").groupBy("namespace").agg(n.alias("flushes"))
    live = entries(log, ttl_s, as_of).groupBy("namespace").agg(n.alias("live"))
    out = by.join(flushed, "namespace", "full").join(live, "namespace", "left").fillna(0)
    return out.withColumn("hit_rate", F.coalesce(F.try_divide("hits", "gets"), F.lit(0.0)))


def prewarm(hot: DataFrame, namespace: str, at: Column, limit: int) -> DataFrame:
    """hot: (key, value, uses). The most used entries as operations of the log, ties by key."""
    best = hot.orderBy(F.desc("uses"), "key").limit(limit)
    return best.select(F.lit(namespace).alias("namespace"), "key", F.lit("prewarm").alias("op"), "value", at.alias("at"), F.lit(0).cast("long").alias("seq"))


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def seal(value: Column, secret: str, bound_to: Column) -> Column:
    """The value under AES in Galois counter mode, as text; it opens only with the secret and the key that it was bound to."""
    return F.base64(F.aes_encrypt(value.cast("binary"), _key(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound_to.cast("binary")))


def unseal(sealed: Column, secret: str, bound_to: Column) -> Column:
    """The value, or null where it does not open."""
    return F.try_aes_decrypt(F.unbase64(sealed), _key(secret), F.lit("GCM"), F.lit("DEFAULT"), bound_to.cast("binary")).cast("string")
