"""Conventions of a repository by language: naming from its symbols, the rest as fixed statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import class_naming, function_naming

# --- fixed values ---------------------------------------------------------------------------------------------------
ERROR_HANDLING = {
    "python": ["Uses try/except blocks", "Raises custom exceptions"],
    "typescript": ["Uses try/catch blocks", "Returns error objects"],
    "javascript": ["Uses try/catch blocks", "Returns error objects"],
    "go": ["Returns error as second value", "Checks if err != nil"],
    "java": ["Uses try/catch blocks", "Declares throws in method signatures"],
}
CODE_STYLE = {"indentation": "4 spaces", "line_length": "80-100 characters", "quotes": "double quotes"}
DOCUMENTATION_STYLE = "Standard docstrings"
#: What is returned for a service whose conventions are not known.
DEFAULTS = {
    "naming": {"functions": "snake_case", "classes": "PascalCase", "constants": "UPPER_SNAKE_CASE"},
    "error_handling": {"pattern": "try-except with logging", "custom_exceptions": True},
    "import_order": {"order": ["stdlib", "third_party", "local"], "style": "absolute"},
}
# --------------------------------------------------------------------------------------------------------------------


def conventions(symbols: DataFrame, importing: DataFrame) -> DataFrame:
    """symbols: (language, name, symbol_type); importing: (language) of files with imports. One row per language."""
    kind = F.col("symbol_type")
    classes, functions = F.when(kind == "class", F.col("name")), F.when(kind.isin("function", "method"), F.col("name"))
    names = symbols.groupBy("language").agg(class_naming(classes).alias("classes"), function_naming(functions).alias("functions"))
    handling = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in ERROR_HANDLING.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("language")), F.array().cast("array<string>"))
    grouped = importing.select("language").distinct().withColumn("grouped", F.array(F.lit("Imports grouped by type")))
    out = names.join(grouped, "language", "left")
    ordering = F.concat(F.coalesce("grouped", F.array().cast("array<string>")), F.array(F.lit("Alphabetically sorted within groups")))
    style = F.create_map(*(F.lit(x) for kv in CODE_STYLE.items() for x in kv))
    return out.select("language", "classes", "functions", handling.alias("error_handling"), ordering.alias("import_ordering"), style.alias("code_style"), F.lit(DOCUMENTATION_STYLE).alias("documentation_style"))


def sample_files(scored: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """scored: (path, score). The best ``size`` files; with a seed and more than twice as many files the last five are drawn from the rest."""
    best = scored.orderBy(F.desc("score"), "path")
    total = scored.count()
    if seed is None or total <= 2 * size or size <= 5:
        return best.limit(size)
    sure = best.limit(size - 5)
    rest = scored.join(best.limit(size), "path", "left_anti")
    return sure.unionByName(rest.orderBy(F.rand(seed), "path").limit(5))
