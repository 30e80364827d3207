"""Registry, jobs, access and audit over immutable tables: a mutation takes a table and gives the next one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------
STATUSES = ("pending", "indexing", "completed", "error")
ROLE_SCOPES = {
    "viewer": ("read:repository", "read:code", "read:dependencies"),
    "developer": ("read:repository", "read:code", "read:dependencies", "trigger:reindex"),
    "admin": ("read:repository", "read:code", "read:dependencies", "write:repository", "trigger:reindex", "admin:users", "admin:keys", "admin:system"),
    "service": ("read:repository", "read:code", "read:dependencies"),
}
ENDPOINT_SCOPES = {"search": "read:code", "resolve-stack-trace": "read:code", "dependency-graph": "read:dependencies", "blast-radius": "read:dependencies", "file": "read:code", "commit-diff": "read:code", "batch": "read:code"}
DEFAULT_ROLE, SUPER_SCOPE = "viewer", "admin:system"
# --------------------------------------------------------------------------------------------------------------------


def upsert(now: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str | None = None) -> DataFrame:
    """now with new merged in by key: a new row replaces the old one; of several new ones the last by ``order`` counts."""
    one = new
    if order:
        one = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return now.join(one.select(*keys), list(keys), "left_anti").unionByName(one, allowMissingColumns=True)


def insert_ignore(now: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds the rows of new whose keys are not there yet, each key once."""
    fresh = new.dropDuplicates(list(keys)).join(now.select(*keys), list(keys), "left_anti")
    return now.unionByName(fresh)


def delete_rows(now: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return now.join(keys.select(*on).distinct(), list(on), "left_anti")


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """The rows of all tables that don't belong to the keys."""
    return {name: delete_rows(t, keys, (key,)) for name, t in tables.items()}


# --- registry -------------------------------------------------------------------------------------------------------


def stale_repositories(repos: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return repos.where((F.col("last_incremental") < limit) & (F.col("status") != "indexing"))


def page(df: DataFrame, order: tuple, limit: int, offset: int = 0) -> DataFrame:
    """A page in a complete order, without which pages would not fit together."""
    return df.orderBy(*order).offset(offset).limit(limit)


def registry_health(repos: DataFrame) -> DataFrame:
    """One row: totals, a count for each status, mean coverage to two places, sums with 0 for none."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES]
    return repos.agg(F.count(F.lit(1)).alias("total"), *counts, F.round(F.coalesce(F.avg("coverage_pct"), F.lit(0.0)), 2).alias("avg_coverage"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("total_errors"))


def update_status(repos: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (repo_id, new_status, message). An error counts only with a message."""
    out = repos.join(changes, "repo_id", "left")
    failed = (F.col("new_status") == "error") & F.col("message").isNotNull()
    return out.withColumn("error_count", F.col("error_count") + F.coalesce(failed, F.lit(False)).cast("int")).withColumn("status", F.coalesce("new_status", "status")).drop("new_status", "message")


def complete_indexing(repos: DataFrame, done: DataFrame) -> DataFrame:
    """done: (repo_id, kind full or incremental, at). Full runs stamp both times."""
    out = repos.join(done, "repo_id", "left")
    full = F.when(F.col("kind") == "full", F.col("at"))
    return out.withColumn("last_full_index", F.coalesce(full, "last_full_index")).withColumn("last_incremental", F.coalesce("at", "last_incremental")).withColumn("status", F.when(F.col("at").isNotNull(), "completed").otherwise(F.col("status"))).drop("kind", "at")


def job_states(events: DataFrame) -> DataFrame:
    """events: (job_id, status, ts). Start is the first ``running``, end the last ``completed`` or ``failed``, status the last."""
    ended = F.col("status").isin("completed", "failed")
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("completed_at"))


# --- access ---------------------------------------------------------------------------------------------------------


def allowed(scopes: Column, wanted: Column) -> Column:
    return F.array_contains(scopes, SUPER_SCOPE) | F.array_contains(scopes, wanted)


def endpoint_scope(endpoint: Column) -> Column:
    """The scope an endpoint asks for; null is public."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ENDPOINT_SCOPES.items() for x in kv)), endpoint)


def role_scopes(role: Column) -> Column:
    table = F.create_map(*(x for k, v in ROLE_SCOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, F.coalesce(role, F.lit(DEFAULT_ROLE))), F.array().cast("array<string>"))


def accessible(repos: DataFrame, members: DataFrame, acl: DataFrame, user) -> DataFrame:
    """Distinct repositories a user may read: public, of an organisation of theirs, or granted."""
    public = repos.where("is_public").select("repo_id")
    owned = repos.join(members.where(F.col("user_id") == user), "org_id", "left_semi").select("repo_id")
    granted = acl.where(F.col("user_id") == user).select("repo_id")
    return public.union(owned).union(granted).distinct()


def access_of(pairs: DataFrame, repos: DataFrame, members: DataFrame, acl: DataFrame) -> DataFrame:
    """pairs: (user_id, repo_id). How each may be accessed, by three existence tests."""
    out = pairs.join(repos, "repo_id", "left")
    out = out.join(members.select("org_id", "user_id").distinct().withColumn("member", F.lit(True)), ["org_id", "user_id"], "left")
    out = out.join(acl.select("repo_id", "user_id").distinct().withColumn("granted", F.lit(True)), ["repo_id", "user_id"], "left")
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_public", "member", "granted")]
    return out.select("user_id", "repo_id", reduce(lambda a, b: a | b, flags).alias("allowed"))


def revoke(acl: DataFrame, user, repo=None) -> DataFrame:
    match = F.col("user_id") == user
    return acl.where(~(match if repo is None else match & (F.col("repo_id") == repo)))


def valid_keys(keys: DataFrame, as_of: Column, environment: str) -> DataFrame:
    """keys: (key_id, environment, revoked, expires_at, created_at), newest first."""
    live = F.isnull("expires_at") | (F.col("expires_at") > as_of)
    return keys.where((F.col("environment") == environment) & ~F.col("revoked") & live).orderBy(F.desc("created_at"), "key_id")


# --- audit ----------------------------------------------------------------------------------------------------------


def audit_filter(log: DataFrame, user=None, event_type=None, resource=None, result=None, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; times are inclusive at both ends."""
    tests = [F.col(c) == v for c, v in (("user_id", user), ("event_type", event_type), ("resource", resource), ("result", result)) if v is not None]
    tests += [F.col("ts") >= start] if start is not None else []
    tests += [F.col("ts") <= end] if end is not None else []
    return page(reduce(DataFrame.where, tests, log), (F.desc("ts"), F.desc("log_id")), limit, offset)


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


def top_resources(log: DataFrame, event_types: tuple[str, ...], limit: int = 10) -> DataFrame:
    return log.where(F.col("event_type").isin(*event_types)).groupBy("resource").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "resource").limit(limit)


def failed_logins(log: DataFrame, user, since) -> DataFrame:
    return log.agg(F.count_if((F.col("event_type") == "auth_failure") & (F.col("user_id") == user) & (F.col("ts") >= since)).alias("failed"))


def retain(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """The log without rows older than so many days."""
    return log.where(F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(days)))


def audit_rows(events: DataFrame, metadata: Column) -> DataFrame:
    """Rows to append, with their metadata as JSON."""
    return events.withColumn("metadata", F.to_json(metadata))


def health(components: DataFrame, by: str) -> DataFrame:
    """(component rows with status) rolled up: none bad healthy, some degraded, all unhealthy."""
    bad = F.count_if(F.col("status") != "healthy")
    n = F.count(F.lit(1))
    return components.groupBy(by).agg(F.when(bad == 0, "healthy").when(bad < n, "degraded").otherwise("unhealthy").alias("health"))


def worst_health(components: DataFrame, by: str) -> DataFrame:
    """The worst status; one that is missing (timeout, exception) counts as unhealthy."""
    severity = F.when(F.col("status") == "healthy", 0).when(F.col("status") == "degraded", 1).otherwise(2)
    return components.groupBy(by).agg(F.element_at(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), F.max(severity) + 1).alias("health"))


# --- API keys -------------------------------------------------------------------------------------------------------


def create_key(keys: DataFrame, key: DataFrame) -> DataFrame:
    """keys with one more that is not revoked and never used."""
    return keys.unionByName(key.withColumns({"revoked": F.lit(False), "usage_count": F.lit(0).cast("long")}), allowMissingColumns=True)


def revoke_key(keys: DataFrame, key_id) -> DataFrame:
    return keys.withColumn("revoked", F.col("revoked") | (F.col("key_id") == key_id))


def rotate_key(keys: DataFrame, key_id, new: DataFrame) -> DataFrame:
    return create_key(revoke_key(keys, key_id), new)


def count_usage(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """uses: a row (key_id, ts) per request. Adds to the count and stamps the last use."""
    new = uses.groupBy("key_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"))
    out = keys.join(new, "key_id", "left")
    last = F.greatest("last_used_at", "t") if "last_used_at" in keys.columns else F.col("t")
    return out.withColumn("usage_count", F.col("usage_count") + F.coalesce("n", F.lit(0))).withColumn("last_used_at", last).drop("n", "t")
