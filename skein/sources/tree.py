"""Repository checkouts as DataFrames. Cloning stays outside; a checkout is a folder that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import parse_file, skip_file
from skein.operators.graph import ancestors

# --- fixed values ---------------------------------------------------------------------------------------------------
SOURCE_SUFFIXES = ("py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java")
SERVICE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "java")
MANIFESTS = {"package.json": "npm", "go.mod": "go_module", "setup.py": "python_package", "pyproject.toml": "python_package", "pom.xml": "maven", "build.gradle": "gradle", "Cargo.toml": "rust_crate"}
MANIFEST_SKIPPED = ("node_modules", "venv", "env", ".venv", "vendor", "target", "build", "dist", ".git")
SNIFFED_BYTES = 8192
# --------------------------------------------------------------------------------------------------------------------


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, content, length) of all files."""
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/")
    where = F.regexp_replace("path", "^file:/*", "/")
    return full.select(F.substring(where, F.length(base) + 1, F.length(where)).alias("path"), "content", "length")


def is_binary(content: Column) -> Column:
    """A NUL or invalid UTF-8 in the first bytes; a character cut off by the limit doesn't count."""
    head = F.substring(content, 1, SNIFFED_BYTES)
    whole = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - k).cast("string")), True) for k in range(4)), F.lit(False))
    cut = F.length(content) > SNIFFED_BYTES
    return F.contains(head, F.lit(b"\x00")) | ~F.when(cut, whole).otherwise(F.is_valid_utf8(head.cast("string")))


def text_files(tree: DataFrame) -> DataFrame:
    return tree.where(~is_binary(F.col("content"))).select("path", F.col("content").cast("string").alias("content"))


def metadata(tree: DataFrame) -> DataFrame:
    """One row: files and lines over text files that are not skipped."""
    kept = text_files(tree.where(~skip_file(F.col("path"))))
    return kept.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum(F.size(F.split("content", "\n"))), F.lit(0)).alias("total_lines"))


def sources(tree: DataFrame, strict: bool = False) -> DataFrame:
    """Files that are parsed: a known suffix and no skipped part."""
    return tree.where(F.lower(F.substring_index("path", ".", -1)).isin(*SOURCE_SUFFIXES) & parse_file(F.col("path"), strict))


def read_file(tree: DataFrame, path: str) -> DataFrame:
    return text_files(tree.where(F.col("path") == path))


def manifests(tree: DataFrame) -> DataFrame:
    """Services by their manifest files: name, root_path, service_type, manifest_file, dependencies."""
    parts, kinds = F.split("path", "/"), F.create_map(*(F.lit(x) for kv in MANIFESTS.items() for x in kv))
    name = F.element_at(parts, -1)
    found = tree.where(name.isin(*MANIFESTS) & ~F.arrays_overlap(parts, F.array(*map(F.lit, MANIFEST_SKIPPED)))).withColumn("text", F.col("content").cast("string"))
    keys = [F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]
    required = F.filter(F.transform(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x.startswith("require")), lambda x: F.try_element_at(F.split(x, r"\s+"), F.lit(2))), lambda x: x.isNotNull())
    kind = F.element_at(kinds, name)
    deps = F.when(kind == "npm", F.concat(*keys)).when(kind == "go_module", required).otherwise(F.array().cast("array<string>"))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return found.select(F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("")).alias("name"), F.array_join(folders, "/").alias("root_path"), kind.alias("service_type"), F.col("path").alias("manifest_file"), deps.alias("dependencies"))


def service_files(services: DataFrame, tree: DataFrame) -> DataFrame:
    """(name, root_path, path) of source files under a service's root: a file meets the services at its folders by an equi-join."""
    files = tree.where(F.substring_index("path", ".", -1).isin(*SERVICE_SUFFIXES) & F.contains("path", F.lit("."))).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, MANIFEST_SKIPPED)))).select("path")
    folders = files.withColumn("root_path", F.explode(ancestors(F.col("path"))))
    return services.select("name", "root_path").join(folders, "root_path").select("name", "root_path", "path")


def changed_since(tree: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is new or differs from known (path, digest): the work of an incremental run."""
    return tree.withColumn("digest", F.sha2("content", 256)).join(known.select("path", "digest"), ["path", "digest"], "left_anti")
