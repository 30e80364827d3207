"""Queries read whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.plans.adapters import tables
from skein.plans.registry import QUERIES


def values(df):
    return {r[0] for r in df.distinct().collect()}


def test_every_file_and_commit_counts(spark, sf):
    modified, imports = tables(spark, sf, "modified", "imports")
    lines = modified.where("lo <= 40 AND hi >= 20")
    assert values(QUERIES["git_blame"](spark, sf).select("file_path")) == values(lines.select("file_path"))
    met = modified.join(imports, F.col("file_path") == F.col("dst"))
    assert values(QUERIES["commit_impact"](spark, sf).select("commit_hash")) == values(met.select("commit_hash"))


def test_every_part_and_whole_texts_count(spark, sf):
    part, talk = tables(spark, sf, "part", "conversations")
    assert values(QUERIES["health_rollup"](spark, sf).select("grp")) == values(part.select("p_size"))
    cleaned = QUERIES["query_validation"](spark, sf).where("conv_id % 6 = 5").select(F.length("cleaned"))
    assert max(values(cleaned)) > 30


def test_risk_counts_five_hops(spark, sf):
    imports, seeds = (df.collect() for df in tables(spark, sf, "imports", "seeds"))
    back: dict = {}
    for r in imports:
        back.setdefault(r["dst"], set()).add(r["src"])
    want = {-1: 0}
    for (seed,) in seeds:
        trails, found = [(seed, frozenset())], set()
        for length in range(1, 6):
            trails = [(src, used | {(src, node)}) for node, used in trails for src in back.get(node, ()) if (src, node) not in used]
            found |= {(node, length) for node, _ in trails}
        want[seed] = len(found)
    assert {r["file_path"]: r["downstream_count"] for r in QUERIES["risk_context"](spark, sf).collect()} == want
