"""Registry, access, audit and time-window queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import relational as rel
from skein.operators import timewin as tw
from skein.plans.adapters import tables, with_views
from skein.sources import cache

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(*views) + (", " if sql[:1] == "+" else " ") + sql.lstrip("+") if views else sql
        return f

    return add


_AS_OF = "TIMESTAMP '{}'"
_NOW = "2001-07-29 00:10:01"


def _ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


# --- registry -------------------------------------------------------------------------------------------------------


@query("stale_repositories", f"SELECT repo_id, status FROM repositories WHERE last_incremental < {_AS_OF.format(_NOW)} - INTERVAL 10 MINUTE AND status <> 'indexing'", "repositories")
def stale_repositories(spark: SparkSession, sf: str) -> DataFrame:
    return rel.stale_repositories(tables(spark, sf, "repositories")[0], _ts(_NOW)).select("repo_id", "status")


@query("registry_health", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in rel.STATUSES) + ", round(coalesce(avg(coverage_pct), 0), 2) AS avg_coverage, coalesce(sum(file_count), 0)::BIGINT AS total_files, coalesce(sum(error_count), 0)::BIGINT AS total_errors FROM repositories", "repositories")
def registry_health(spark: SparkSession, sf: str) -> DataFrame:
    return rel.registry_health(tables(spark, sf, "repositories")[0])


@query("recent_jobs", "SELECT job_id, repo_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 10", "jobs")
def recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "jobs")[0].orderBy(F.desc("created_at"), "job_id").limit(10)


@query("repository_page", "SELECT repo_id, name, status FROM repositories WHERE status <> 'error' ORDER BY repo_id LIMIT 7 OFFSET 5", "repositories")
def repository_page(spark: SparkSession, sf: str) -> DataFrame:
    return rel.page(tables(spark, sf, "repositories")[0].where("status <> 'error'"), ("repo_id",), 7, 5).select("repo_id", "name", "status")


@query("status_updates", "+c AS (SELECT repo_id, CASE WHEN repo_id % 2 = 0 THEN 'error' ELSE 'completed' END AS new_status, CASE WHEN repo_id % 4 = 0 THEN 'boom' END AS message FROM repositories WHERE repo_id < 12) SELECT r.repo_id, coalesce(new_status, status) AS status, error_count + coalesce((new_status = 'error' AND message IS NOT NULL)::INT, 0) AS error_count FROM repositories r LEFT JOIN c ON c.repo_id = r.repo_id", "repositories")
def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    (repos,) = tables(spark, sf, "repositories")
    changes = repos.where("repo_id < 12").select("repo_id", F.when(F.col("repo_id") % 2 == 0, "error").otherwise("completed").alias("new_status"), F.when(F.col("repo_id") % 4 == 0, "boom").alias("message"))
    return rel.update_status(repos, changes).select("repo_id", "status", "error_count")


@query("completed_runs", f"SELECT repo_id, CASE WHEN repo_id < 9 THEN 'completed' ELSE status END AS status, CASE WHEN repo_id < 9 AND repo_id % 2 = 0 THEN {_AS_OF.format(_NOW)} END AS last_full_index, CASE WHEN repo_id < 9 THEN {_AS_OF.format(_NOW)} ELSE last_incremental END AS last_incremental FROM repositories", "repositories")
def completed_runs(spark: SparkSession, sf: str) -> DataFrame:
    repos = tables(spark, sf, "repositories")[0].withColumn("last_full_index", F.lit(None).cast("timestamp_ntz"))
    done = repos.where("repo_id < 9").select("repo_id", F.when(F.col("repo_id") % 2 == 0, "full").otherwise("incremental").alias("kind"), _ts(_NOW).alias("at"))
    return rel.complete_indexing(repos, done).select("repo_id", "status", "last_full_index", "last_incremental")


_JOB = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("job_states", f"WITH e AS (SELECT user_id AS job_id, {_JOB} AS status, ts FROM events) SELECT job_id, arg_max(status, struct_pack(ts := ts, status := status)) AS status, min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at FROM e GROUP BY job_id")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = tables(spark, sf, "events")
    return rel.job_states(events.select(F.col("user_id").alias("job_id"), F.expr(_JOB).alias("status"), "ts"))


@query("upserted_files", "+n AS (SELECT file_path + 500 AS file_path, 'new' AS language, total_lines FROM files WHERE file_path % 3 = 0) SELECT file_path, language, total_lines FROM files WHERE file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT * FROM n", "files")
def upserted_files(spark: SparkSession, sf: str) -> DataFrame:
    (files,) = tables(spark, sf, "files")
    new = files.where("file_path % 3 = 0").select((F.col("file_path") + 500).alias("file_path"), F.lit("new").alias("language"), "total_lines")
    return rel.upsert(files, new.union(new), ("file_path",), "total_lines")


@query("cascade_delete", "SELECT 'jobs' AS of, count(*) AS n FROM jobs WHERE repo_id NOT IN (3, 7, 11) UNION ALL SELECT 'repositories', count(*) FROM repositories WHERE repo_id NOT IN (3, 7, 11)", "jobs", "repositories")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    jobs, repos = tables(spark, sf, "jobs", "repositories")
    left = rel.delete_cascade({"jobs": jobs, "repositories": repos}, repos.where(F.col("repo_id").isin(3, 7, 11)), "repo_id")
    counts = [t.agg(F.lit(n).alias("of"), F.count(F.lit(1)).alias("n")) for n, t in left.items()]
    return counts[0].union(counts[1])


# --- access ---------------------------------------------------------------------------------------------------------

_USER = 7


@query("accessible_repositories", f"SELECT repo_id FROM repo_owners WHERE is_public UNION SELECT o.repo_id FROM repo_owners o JOIN members m ON m.org_id = o.org_id WHERE m.user_id = {_USER} UNION SELECT repo_id FROM acl WHERE user_id = {_USER}", "repo_owners", "members", "acl")
def accessible_repositories(spark: SparkSession, sf: str) -> DataFrame:
    return rel.accessible(*tables(spark, sf, "repo_owners", "members", "acl"), _USER)


@query("access_checks", "+p AS (SELECT o_custkey % 60 AS user_id, l_partkey AS repo_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT p.user_id, p.repo_id, coalesce(o.is_public, false) OR EXISTS (SELECT 1 FROM members m WHERE m.org_id = o.org_id AND m.user_id = p.user_id) OR EXISTS (SELECT 1 FROM acl a WHERE a.repo_id = p.repo_id AND a.user_id = p.user_id) AS allowed FROM p LEFT JOIN repo_owners o ON o.repo_id = p.repo_id", "repo_owners", "members", "acl")
def access_checks(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders, owners, members, acl = tables(spark, sf, "lineitem", "orders", "repo_owners", "members", "acl")
    pairs = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 60).alias("user_id"), F.col("l_partkey").alias("repo_id")).distinct()
    return rel.access_of(pairs, owners, members, acl)


_SCOPES = " ".join(f"WHEN '{r}' THEN {list(s)}" for r, s in rel.ROLE_SCOPES.items())
_ENDPOINTS = " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in rel.ENDPOINT_SCOPES.items())


@query("permissions", f"+a AS (SELECT user_id, repo_id, role, CASE repo_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'blast-radius' WHEN 2 THEN 'health' ELSE 'batch' END AS endpoint FROM acl), s AS (SELECT *, CASE role {_SCOPES} END AS scopes, CASE endpoint {_ENDPOINTS} END AS wanted FROM a) SELECT user_id, repo_id, role, endpoint, wanted, wanted IS NULL OR list_contains(scopes, 'admin:system') OR list_contains(scopes, wanted) AS allowed, list_contains(scopes, 'admin:system') OR list_contains(scopes, 'trigger:reindex') AS may_reindex FROM s", "acl")
def permissions(spark: SparkSession, sf: str) -> DataFrame:
    (acl,) = tables(spark, sf, "acl")
    step = F.col("repo_id") % 4
    a = acl.withColumn("endpoint", F.when(step == 0, "search").when(step == 1, "blast-radius").when(step == 2, "health").otherwise("batch"))
    a = a.withColumns({"wanted": rel.endpoint_scope(F.col("endpoint")), "scopes": rel.role_scopes(F.col("role"))})
    ok = F.isnull("wanted") | F.coalesce(rel.allowed(F.col("scopes"), F.col("wanted")), F.lit(False))
    return a.select("user_id", "repo_id", "role", "endpoint", "wanted", ok.alias("allowed"), rel.allowed(F.col("scopes"), F.lit("trigger:reindex")).alias("may_reindex"))


@query("grants_and_revocations", "+n AS (SELECT DISTINCT user_id, repo_id + 1 AS repo_id FROM acl WHERE role = 'admin'), g AS (SELECT user_id, repo_id, role FROM acl UNION ALL SELECT user_id, repo_id, 'viewer' FROM n WHERE NOT EXISTS (SELECT 1 FROM acl a WHERE a.user_id = n.user_id AND a.repo_id = n.repo_id)) SELECT role, count(*) AS n FROM g WHERE user_id <> 11 GROUP BY role", "acl")
def grants_and_revocations(spark: SparkSession, sf: str) -> DataFrame:
    (acl,) = tables(spark, sf, "acl")
    new = acl.where("role = 'admin'").select("user_id", (F.col("repo_id") + 1).alias("repo_id"), F.lit("viewer").alias("role"))
    return rel.revoke(rel.insert_ignore(acl, new, ("user_id", "repo_id")), 11).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("valid_keys", f"SELECT o_orderkey AS key_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 0 AND (o_custkey % 2 = 0 OR o_orderdate + INTERVAL 365 DAY > {_AS_OF.format('1997-06-01 00:00:00')})")
def valid_keys(spark: SparkSession, sf: str) -> DataFrame:
    (orders,) = tables(spark, sf, "orders")
    keys = orders.select(F.col("o_orderkey").alias("key_id"), F.col("o_orderstatus").alias("environment"), (F.col("o_custkey") % 3 == 0).alias("revoked"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"), F.col("o_orderdate").alias("created_at"))
    return rel.valid_keys(keys, _ts("1997-06-01 00:00:00"), "O").select("key_id", "created_at")


# --- audit ----------------------------------------------------------------------------------------------------------

_FROM, _TO = "(SELECT min(ts) + INTERVAL 1 HOUR FROM events)", "(SELECT min(ts) + INTERVAL 100 DAY FROM events)"


def _bounds(log: DataFrame):
    first = log.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return F.lit((first + timedelta(hours=1)).isoformat(" ")).cast("timestamp_ntz"), F.lit((first + timedelta(days=100)).isoformat(" ")).cast("timestamp_ntz")


@query("audit_search", f"SELECT log_id, user_id, ts FROM audit WHERE event_type = 'search' AND result = 'success' AND ts >= {_FROM} AND ts <= {_TO} ORDER BY ts DESC, log_id DESC LIMIT 50 OFFSET 10", "audit")
def audit_search(spark: SparkSession, sf: str) -> DataFrame:
    (log,) = tables(spark, sf, "audit")
    start, end = _bounds(log)
    return rel.audit_filter(log, event_type="search", result="success", start=start, end=end, limit=50, offset=10).select("log_id", "user_id", "ts")


@query("audit_event_counts", "SELECT event_type, count(*) AS n FROM audit GROUP BY event_type", "audit")
def audit_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rel.event_counts(tables(spark, sf, "audit")[0])


@query("audit_top_resources", "SELECT resource, count(*) AS n FROM audit WHERE event_type IN ('search', 'file_access', 'blast_radius') GROUP BY resource ORDER BY n DESC, resource LIMIT 10", "audit")
def audit_top_resources(spark: SparkSession, sf: str) -> DataFrame:
    return rel.top_resources(tables(spark, sf, "audit")[0], ("search", "file_access", "blast_radius"))


@query("audit_failed_logins", f"SELECT count(*) AS failed FROM audit WHERE event_type = 'auth_failure' AND user_id = 5 AND ts >= {_FROM}", "audit")
def audit_failed_logins(spark: SparkSession, sf: str) -> DataFrame:
    (log,) = tables(spark, sf, "audit")
    return rel.failed_logins(log, 5, _bounds(log)[0])


@query("audit_retention", "SELECT event_type, count(*) AS n FROM audit WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1", "audit")
def audit_retention(spark: SparkSession, sf: str) -> DataFrame:
    (log,) = tables(spark, sf, "audit")
    last = F.lit(log.agg(F.max("ts")).first()[0].isoformat(" ")).cast("timestamp_ntz")
    return rel.retain(log, last, 10).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("audit_metadata", "SELECT event_id, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS metadata FROM events")
def audit_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return rel.audit_rows(tables(spark, sf, "events")[0], F.struct("user_id", "event_type")).select("event_id", "metadata")


_PART = "(SELECT p_size AS grp, CASE WHEN p_retailprice < 960 THEN 'unhealthy' WHEN p_retailprice < 990 THEN 'degraded' ELSE 'healthy' END AS status FROM part)"


@query("health_rollup", f"SELECT grp, CASE WHEN count(*) FILTER (status <> 'healthy') = 0 THEN 'healthy' WHEN count(*) FILTER (status <> 'healthy') < count(*) THEN 'degraded' ELSE 'unhealthy' END AS health, CASE max(CASE status WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS worst FROM {_PART} GROUP BY grp")
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = tables(spark, sf, "part")
    price = F.col("p_retailprice")
    parts = part.select(F.col("p_size").alias("grp"), F.when(price < 960, "unhealthy").when(price < 990, "degraded").otherwise("healthy").alias("status"))
    return rel.health(parts, "grp").join(rel.worst_health(parts, "grp").withColumnRenamed("health", "worst"), "grp")


_OPS = "SELECT CAST(user_id % 4 AS VARCHAR) AS namespace, CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 97 AS VARCHAR) END AS key, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'set' WHEN 'purchase' THEN 'prewarm' WHEN 'error' THEN CASE WHEN user_id % 7 = 0 THEN 'flush' ELSE 'delete' END ELSE 'get' END AS op, event_type AS value, ts AS at, event_id AS seq FROM events"


@query("cache_statistics", f"WITH o AS ({_OPS.replace(' AS at,', ' AS t,')}), g AS (SELECT *, count(*) FILTER (op = 'flush') OVER (PARTITION BY namespace ORDER BY t, seq) AS gen FROM o), n AS (SELECT namespace, max(gen) AS gen FROM g GROUP BY 1), m AS (SELECT TIMESTAMP '2024-02-01' AS t), a AS (SELECT namespace, key, op, t, seq, gen, false AS asked FROM g WHERE op <> 'flush' UNION ALL SELECT DISTINCT o.namespace, o.key, 'get', m.t, 4611686018427387904, n.gen, true FROM o JOIN n ON n.namespace = o.namespace, m WHERE o.key IS NOT NULL), h AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {{'op': op, 't': t}} END IGNORE NULLS) OVER (PARTITION BY namespace, key, gen ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM a), r AS (SELECT *, coalesce(held.op IN ('set', 'prewarm'), false) AND coalesce(epoch(t) - epoch(held.t) < CASE namespace WHEN '0' THEN 86400 WHEN '1' THEN 604800 WHEN '2' THEN 3600 END, true) AS hit FROM h) SELECT r.namespace, count(*) FILTER (op = 'get' AND NOT asked) AS gets, count(*) FILTER (op = 'get' AND NOT asked AND hit) AS hits, count(*) FILTER (op IN ('set', 'prewarm')) AS stored, count(*) FILTER (asked AND hit) AS live, (SELECT count(*) FROM o WHERE o.op = 'flush' AND o.namespace = r.namespace) AS flushes FROM r GROUP BY 1")
def cache_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Operations made of the events; namespaces have times to live, the last one none."""
    (events,) = tables(spark, sf, "events")
    log = spark.sql(_OPS.replace("VARCHAR", "STRING").replace("FROM events", "FROM {events}"), events=events)
    stats = cache.statistics(log, {"0": 86400, "1": 604800, "2": 3600}, F.lit("2024-02-01").cast("timestamp_ntz"))
    return stats.select("namespace", "gets", "hits", "stored", "live", "flushes")


@query("cache_hit_rate", "SELECT user_id % 10 AS ns, coalesce(sum((event_type = 'view')::INT) / nullif(sum((event_type IN ('view', 'click'))::INT), 0), 0)::DOUBLE AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    hits, both = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "click"))
    return tables(spark, sf, "events")[0].groupBy((F.col("user_id") % 10).alias("ns")).agg(F.coalesce(F.try_divide(hits, both), F.lit(0.0)).alias("hit_rate"))


@query("nearest_rank_percentiles", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT q AS quantile, value FROM s, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q) WHERE i = least(floor(n * q), n - 1)")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return tw.nearest_rank(tables(spark, sf, "events")[0], (0.5, 0.95, 0.99))


@query("usage_totals", "SELECT user_id, sum(n)::BIGINT AS used, greatest(0, 120 - sum(n))::BIGINT AS remaining FROM (SELECT user_id, endpoint, count(*) AS n FROM requests GROUP BY 1, 2) GROUP BY 1", "requests")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    used = tables(spark, sf, "requests")[0].groupBy("user_id", "endpoint").agg(F.count(F.lit(1)).alias("used"))
    return tw.usage_totals(used, 120)


@query("ingest_throughput", "SELECT language, sum(total_lines)::BIGINT AS lines, round(sum(total_lines) / 1000.0 / (count(*) / 60.0), 6)::DOUBLE AS kloc_per_minute FROM files GROUP BY 1", "files")
def ingest_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """As if each file took a second."""
    return tables(spark, sf, "files")[0].groupBy("language").agg(F.sum("total_lines").alias("lines"), F.round(F.sum("total_lines") / 1000.0 / (F.count(F.lit(1)) / 60.0), 6).alias("kloc_per_minute"))


@query("commit_totals", "+m AS (SELECT commit_hash, count(DISTINCT file_path) AS files, sum(hi - lo) AS lines FROM modified GROUP BY 1) SELECT author, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines FROM m JOIN commits c ON c.commit_hash = m.commit_hash GROUP BY 1", "modified", "commits")
def commit_totals(spark: SparkSession, sf: str) -> DataFrame:
    modified, commits = tables(spark, sf, "modified", "commits")
    m = modified.groupBy("commit_hash").agg(F.countDistinct("file_path").alias("files"), F.sum(F.col("hi") - F.col("lo")).alias("lines"))
    return m.join(commits, "commit_hash").groupBy("author").agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))


@query("name_set_algebra", "SELECT n_name AS name, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) AS rich_supplier FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -500)")
def name_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection and difference of name sets."""
    nation, customer, supplier = tables(spark, sf, "nation", "customer", "supplier")
    a = customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    b = supplier.where("s_acctbal < -500").select(F.col("s_nationkey").alias("n_nationkey"))
    rich = supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("rich_supplier", F.lit(True))
    keys = nation.select("n_nationkey").intersect(a).subtract(b)
    return nation.join(keys, "n_nationkey").join(rich, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.coalesce("rich_supplier", F.lit(False)).alias("rich_supplier"))


# --- time windows ---------------------------------------------------------------------------------------------------


@query("sliding_request_counts", "SELECT event_id, count(*) OVER w AS in_window, (min(epoch(date_trunc('second', ts))) OVER w)::BIGINT + 86400 AS reset_at FROM requests WINDOW w AS (PARTITION BY user_id, endpoint ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)", "requests")
def sliding_request_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tw.sliding_counts(tables(spark, sf, "requests")[0], 86400).select("event_id", "in_window", "reset_at")


@query("tumbling_limits", "+s AS (SELECT event_id, user_id, epoch(date_trunc('hour', ts))::BIGINT AS second FROM requests), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, second // 10 ORDER BY second, event_id) > 3 AS full FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, \"full\", second // 60 ORDER BY second, event_id) AS nth FROM b) SELECT event_id, user_id, CASE WHEN \"full\" THEN 'burst' WHEN nth > 2 THEN 'minute' ELSE 'allowed' END AS verdict FROM m", "requests")
def tumbling_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Times cut to hours, so that buckets fill up."""
    requests = tables(spark, sf, "requests")[0].withColumn("ts", F.date_trunc("hour", "ts"))
    return tw.tumbling_limit(requests, 2, 3)


@query("bucket_usage", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS used, greatest(0, 3 - count(*)) AS remaining FROM requests GROUP BY 1, 2", "requests")
def bucket_usage(spark: SparkSession, sf: str) -> DataFrame:
    return tw.bucket_usage(tables(spark, sf, "requests")[0], "1 hour", 3)


@query("concurrency_peaks", "+s AS (SELECT user_id, ts AS moment, 1 AS step FROM requests UNION ALL SELECT user_id, ts + to_seconds(floor(value)::BIGINT * 600), -1 FROM requests), r AS (SELECT user_id, step, sum(step) OVER (PARTITION BY user_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT user_id, max(n)::BIGINT AS peak, count(*) FILTER (n > 5) AS over_limit FROM r WHERE step = 1 GROUP BY 1", "requests")
def concurrency_peaks(spark: SparkSession, sf: str) -> DataFrame:
    spans = tables(spark, sf, "requests")[0].select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=(F.floor("value") * 600).cast("decimal(18,6)"))).alias("end"))
    return tw.concurrency(spans)


@query("event_rates", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) / 3600.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    return tw.event_rate(tables(spark, sf, "events")[0], 3600, ("event_type",))


_EDGES = (10.0, 25.0, 50.0, 100.0, 200.0)


def _quantile_sql(q: float) -> str:
    parts = []
    for i, e in enumerate(_EDGES):
        low, below = (_EDGES[i - 1], f"b{i - 1}") if i else (0.0, "0")
        parts.append(f"WHEN b{i} >= {q} * n THEN {low}::DOUBLE + ({e}::DOUBLE - {low}) * (({q}::DOUBLE * n - {below}) / nullif(b{i} - {below}, 0))")
    counts = ", ".join(f"count(*) FILTER (value <= {e}) AS b{i}" for i, e in enumerate(_EDGES))
    return f"WITH c AS (SELECT event_type, count(value) AS n, {counts} FROM events GROUP BY 1) SELECT event_type, n, round(CASE {' '.join(parts)} ELSE {_EDGES[-1]} END, 6)::DOUBLE AS quantile FROM c WHERE n > 0"


@query("latency_quantiles", _quantile_sql(0.95))
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return tw.histogram_quantile(tables(spark, sf, "events")[0], _EDGES, 0.95, ("event_type",)).withColumn("quantile", F.round("quantile", 6))


@query("counter_rates", "WITH s AS (SELECT user_id, ts, value, lag(value) OVER w AS b, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER w AS d FROM (SELECT user_id, ts, min(value) AS value FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts, round((CASE WHEN value >= b THEN value - b ELSE value END) / nullif(d, 0), 6) AS rate FROM s WHERE d <> 0")
def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    samples = tables(spark, sf, "events")[0].groupBy("user_id", "ts").agg(F.min("value").alias("value"))
    return tw.counter_rate(samples, ("user_id",)).select("user_id", "ts", F.round("rate", 6).alias("rate"))


@query("hit_ratios", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, coalesce(sum((event_type = 'view')::INT) / nullif(sum((event_type IN ('view', 'error'))::INT), 0), 0)::DOUBLE AS ratio FROM events GROUP BY 1")
def hit_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return tw.ratio(tables(spark, sf, "events")[0], F.col("event_type") == "view", F.col("event_type") == "error", 3600)


@query("firing_alerts", "WITH s AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) / 3600.0::DOUBLE AS rate FROM events GROUP BY 1, 2), h AS (SELECT *, rate > 0.0002 AS holds FROM s), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) - row_number() OVER (PARTITION BY event_type, holds ORDER BY bucket) AS island FROM h) SELECT event_type, min(bucket) AS since, max(bucket) AS until FROM i WHERE holds GROUP BY event_type, island HAVING epoch(max(bucket)) - epoch(min(bucket)) >= 7200")
def firing_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rates = tw.event_rate(tables(spark, sf, "events")[0], 3600, ("event_type",))
    return tw.firing(rates, F.col("rate") > 0.0002, 7200, ("event_type",))


@query("job_progress", "+s AS (SELECT repo_id, count(*) AS n, count(*) FILTER (status = 'F') AS done, epoch(max(created_at) - min(created_at))::BIGINT AS elapsed_s FROM jobs GROUP BY 1) SELECT repo_id, round(100.0 * done / n, 2)::DOUBLE AS progress, elapsed_s FROM s", "jobs")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    (jobs,) = tables(spark, sf, "jobs")
    elapsed = tw.seconds(F.max("created_at")) - tw.seconds(F.min("created_at"))
    return jobs.groupBy("repo_id").agg(F.round(100.0 * F.count_if(F.col("status") == "F") / F.count(F.lit(1)), 2).alias("progress"), elapsed.alias("elapsed_s"))


@query("admissions")
def admissions(spark: SparkSession, sf: str) -> DataFrame:
    """A recursive fold (rejected requests don't count later); tests hold it against a plain program."""
    return tw.admit(tables(spark, sf, "requests")[0].withColumn("endpoint", F.lit("search")))


@query("breaker_states")
def breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    """A state machine; tests hold it against a plain program."""
    return tw.breaker_states(tables(spark, sf, "requests")[0].withColumn("failed", F.col("value") > 60))


@query("key_usage", "WITH u AS (SELECT user_id AS key_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey AS key_id, (c_custkey % 7 + coalesce(n, 0))::BIGINT AS usage_count, t AS last_used_at, c_custkey = 12 AS revoked FROM customer LEFT JOIN u ON u.key_id = c_custkey")
def key_usage(spark: SparkSession, sf: str) -> DataFrame:
    customer, events = tables(spark, sf, "customer", "events")
    keys = customer.select(F.col("c_custkey").alias("key_id"), (F.col("c_custkey") % 7).alias("usage_count"), F.lit(False).alias("revoked"))
    uses = events.where("event_type = 'view'").select(F.col("user_id").alias("key_id"), "ts")
    return rel.count_usage(rel.revoke_key(keys, 12), uses).select("key_id", "usage_count", "last_used_at", "revoked")
