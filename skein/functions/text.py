"""Column functions over paths, queries, messages and source text. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------
GRAPH_PATTERNS = ("depend", "import", "call.*chain", "upstream", "downstream", "blast.*radius", "impact", "affect", "service.*topology")
SEMANTIC_PATTERNS = ("find.*function", "search.*for", "where.*is", "show.*me", "locate", "authentication", "database.*connection", "error.*handling", "logging", "validation")
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "rb": "ruby", "rs": "rust", "cpp": "cpp", "c": "c", "h": "c"}
SKIPPED_FOLDERS = ("node_modules", "venv", "env", "__pycache__", "dist", "build", "target", ".git")
SKIPPED_EXTENSIONS = ("pyc", "pyo", "so", "dylib", "dll", "exe", "bin", "jpg", "jpeg", "png", "gif", "pdf", "zip", "tar", "gz", "lock")
UNPARSED_PARTS = ("node_modules", "venv", "env", ".venv", "vendor", "target", "build", "dist", "__pycache__", ".git", "test", "tests", "spec")
SQL_PATTERNS = (r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b)", r"(--|;|\/\*|\*\/)", r"(\bOR\b.*=.*)", r"(\bAND\b.*=.*)")
SCRIPT_PATTERNS = (r"<script[^>]*>.*?</script>", "javascript:", r"on\w+\s*=")
COMMENT_STARTS = {"python": ("#",), "go": ("//", "/*", "*"), "java": ("//", "/*", "*"), "javascript": ("//", "/*", "*"), "typescript": ("//", "/*", "*")}
OTHER_COMMENT_STARTS = ("#", "//")
FRAMES = (r'File "([^"]+)", line (\d+), in (\w+)', r"at ([\w.]+)\(([\w.]+):(\d+)\)", r"at (\w+) \(([^:]+):(\d+):(\d+)\)")
TOKEN_CHARS = 4
# --------------------------------------------------------------------------------------------------------------------


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def classify_query(query: Column, endpoint: Column | None = None, include_graph: Column | None = None) -> Column:
    """graph, semantic, file or hybrid: by endpoint if it tells, else by which patterns hit more; ties are semantic."""
    text = F.lower(query)
    graph, semantic = _hits(text, GRAPH_PATTERNS), _hits(text, SEMANTIC_PATTERNS)
    by_text = F.when(graph > semantic, "graph").otherwise("semantic")
    if endpoint is None:
        return by_text
    hybrid = F.when(F.coalesce(include_graph if include_graph is not None else F.lit(False), F.lit(False)), "hybrid").otherwise("semantic")
    tells = F.when(endpoint.contains("dependency") | endpoint.contains("blast-radius"), "graph").when(endpoint.contains("file"), "file").when(endpoint.contains("search"), hybrid)
    return F.coalesce(tells, by_text)


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def search_hints(query: Column, k: Column) -> tuple[Column, Column]:
    """The k multiplier and whether to page."""
    return F.when(word_count(query) > 10, 1.5).otherwise(1.0), k > 20


def graph_timeout(max_hops: Column, timeout: int = 10) -> Column:
    return F.when(max_hops > 5, timeout * 2).otherwise(timeout)


def use_cache(kind: Column, operation: Column, query: Column) -> Column:
    graph = operation.isin("blast_radius", "service_topology", "call_chain")
    return F.when(kind == "file", True).when(kind == "graph", F.coalesce(graph, F.lit(False))).when(kind == "semantic", word_count(query) >= 5).otherwise(False)


def query_cost_ms(kind: Column, operation: Column, k: Column, hops: Column) -> Column:
    graph = F.when(operation == "blast_radius", 200 * F.pow(F.lit(2.0), hops)).otherwise(150 + hops * 50)
    return F.when(kind == "semantic", 100 + k * 10).when(kind == "graph", graph).when(kind == "file", 50).when(kind == "hybrid", 500).otherwise(0).cast("double")


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(path, ".", -1))), F.lit("unknown"))


def skip_file(path: Column) -> Column:
    """Hidden parts, dependency and build folders, binary extensions."""
    parts, name = F.split(path, "/"), F.substring_index(path, "/", -1)
    extension = F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.substring_index(name, ".", -1)))
    return F.exists(parts, lambda p: p.startswith(".")) | F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) | F.coalesce(extension.isin(*SKIPPED_EXTENSIONS), F.lit(False))


def parse_file(path: Column, strict: bool = False) -> Column:
    """Whether a file is parsed: no skipped part in its path, as text anywhere or (strict) as a whole part."""
    if strict:
        return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, UNPARSED_PARTS)))
    return ~reduce(lambda a, b: a | b, (path.contains(p) for p in UNPARSED_PARTS))


def is_test_file(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    endings = ("_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts", "test.java", "_test.go")
    named = reduce(lambda a, b: a | b, (name.endswith(e) for e in endings))
    return (name.startswith("test_") & name.endswith(".py")) | named | path.contains("/test/") | path.contains("/tests/")


def check_query(query: Column, most: int = 500) -> Column:
    """Status of a search query: empty, too_long, sql, script or ok, in the order of the checks."""
    sql = reduce(lambda a, b: a | b, (query.rlike("(?i)" + p) for p in SQL_PATTERNS))
    script = reduce(lambda a, b: a | b, (query.rlike("(?i)" + p) for p in SCRIPT_PATTERNS))
    return F.when(query.isNull() | (F.trim(query) == ""), "empty").when(F.char_length(query) > most, "too_long").when(sql, "sql").when(script, "script").otherwise("ok")


def clean_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"[\x00-\x1f\x7f-\x9f]", ""))


def check_path(path: Column, most: int = 1000) -> Column:
    return F.when(path.isNull() | (F.trim(path) == ""), "empty").when(F.char_length(path) > most, "too_long").when(path.contains("..") | path.contains("~") | path.startswith("/"), "traversal").otherwise("ok")


def normal_path(path: Column) -> Column:
    """Without doubled or closing slashes and ``.`` parts."""
    parts = F.filter(F.split(path, "/+"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def check_repo_id(repo_id: Column) -> Column:
    uuid = repo_id.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(F.char_length(repo_id) > 100, "too_long").when(uuid, "uuid").when(repo_id.rlike("^[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+$"), "owner_name").otherwise("invalid")


def check_commit(sha: Column) -> Column:
    """The lower-case hash if it has 7 to 40 hexadecimal digits, else null."""
    return F.when(sha.rlike("^[0-9a-fA-F]{7,40}$"), F.lower(sha))


def redact(message: Column) -> Column:
    out = F.regexp_replace(message, r"/[\w/.-]+", "[PATH]")
    out = F.regexp_replace(out, r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]")
    return F.regexp_replace(out, r"\b[a-zA-Z0-9]{32,}\b", "[REDACTED]")


def stack_frames(traces: DataFrame, text_col: str = "trace", extended: bool = False) -> DataFrame:
    """One row per frame line: position, raw_frame, file_path, line_number, function. Blank lines are no frames.

    extended also takes names such as <module> and Go's ``path.go:12``.
    """
    lines = traces.select(*[c for c in traces.columns if c != text_col], F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    python, java, js = FRAMES
    if extended:
        python = python.replace(r"(\w+)", r"([\w<>]+)")
    line, u = F.col("line"), "(?U)"

    def got(pattern: str, i: int) -> Column:
        return F.when(line.rlike(u + pattern), F.regexp_extract(line, u + pattern, i))

    path, number, function = F.coalesce(got(python, 1), got(java, 2), got(js, 2)), F.coalesce(got(python, 2), got(java, 3), got(js, 3)), F.coalesce(got(python, 3), got(java, 1), got(js, 1))
    if extended:
        go = r"^\s*(\S+\.go):(\d+)"
        path, number = F.coalesce(path, got(go, 1)), F.coalesce(number, got(go, 2))
    return lines.select(*[c for c in traces.columns if c != text_col], "pos", F.trim(line).alias("raw_frame"), path.alias("file_path"), number.cast("int").alias("line_number"), function.alias("function"))


def line_counts(text: Column, language: Column) -> tuple[Column, Column, Column]:
    """(all, comment, code) lines; blank lines are neither comment nor code."""
    lines = F.split(text, "\n")

    def comment(line: Column) -> Column:
        line = F.ltrim(line)

        def starts(marks: tuple[str, ...]) -> Column:
            return reduce(lambda a, b: a | b, (line.startswith(m) for m in marks))

        out = F.when(language == "python", starts(COMMENT_STARTS["python"]))
        return out.when(language.isin(*[k for k in COMMENT_STARTS if k != "python"]), starts(COMMENT_STARTS["go"])).otherwise(starts(OTHER_COMMENT_STARTS))

    full = F.filter(lines, lambda x: F.trim(x) != "")
    comments = F.size(F.filter(full, comment))
    return F.size(lines), comments, F.size(full) - comments


def _every(where: Column, holds: Column) -> Column:
    """Whether the condition holds for every row of a group where the first one does; an aggregate of one bit."""
    return F.coalesce(F.bool_and(F.when(where, holds)), F.lit(True))


def class_naming(name: Column) -> Column:
    """What a group's class names have in common; nulls are no names."""
    upper = _every(name != "", F.substring(name, 1, 1).rlike(r"\p{Lu}"))
    return F.when(F.count(name) == 0, "Unknown").when(upper, "PascalCase (UpperCamelCase)").otherwise("Mixed case")


def function_naming(name: Column) -> Column:
    """What a group's function names have in common; names of up to three characters don't count against snake_case."""
    snake = _every(F.char_length(name) > 3, name.contains("_"))
    camel = _every(name != "", F.substring(name, 1, 1).rlike(r"\p{Ll}") & name.rlike(r"^.+\p{Lu}"))
    return F.when(F.count(name) == 0, "Unknown").when(snake, "snake_case").when(camel, "camelCase").otherwise("Mixed case")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / TOKEN_CHARS)


def entity_tag(row: Column) -> Column:
    """MD5 of a row's JSON."""
    return F.md5(F.to_json(row))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The name-based UUID (SHA-1) of a text in a namespace, by default the DNS one."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
