"""The queries of this package and their SQL, as ``__spark_entry__.py`` adds them."""

from __future__ import annotations

import corpus_pipeline
from skein.llm import decontaminate, exact_dedup, langid, license_scan, minhash, mixing, prefix_trie, quality, repair, suffix_dedup, token_count, token_store, toxicity


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_token_shards": token_store.op2_token_shards,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_language_id": langid.op8_language_id,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_repair": repair.op11_repair,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality": quality.op13_quality,
    "pipeline": pipeline,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
