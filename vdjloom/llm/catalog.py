"""The registered queries of this subpackage, as (query, DuckDB SQL or None)."""

from __future__ import annotations

from vdjloom.llm import (
    chosenpath, hardneg, langid, licenses, mixing, pii, prefixtrie, rollup, search, shard, toxicity, warc, winnow,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_capture_merge": (lambda s, d: warc.capture_history(_table(s, d, "pages")), warc.SQL),
    "op2_toxicity": (lambda s, d: toxicity.toxicity(_table(s, d, "documents"), _table(s, d, "labels")), None),
    "op3_language": (lambda s, d: langid.identify(_table(s, d, "documents")), None),
    "op4_top_k": (lambda s, d: search.top_k(_table(s, d, "embeddings")), search.SQL),
    "op5_shards": (lambda s, d: shard.shard(_table(s, d, "documents")), None),
    "op6_mixture": (lambda s, d: mixing.summary(_table(s, d, "documents")), mixing.SQL),
    "op7_decontaminate": (lambda s, d: winnow.decontaminate(_table(s, d, "documents"), _table(s, d, "benchmark")), None),
    "op8_licenses": (lambda s, d: licenses.scan(_table(s, d, "documents")), licenses.SQL),
    "op9_near_duplicates": (lambda s, d: chosenpath.near_duplicates(_table(s, d, "documents")), None),
    "op10_token_counts": (lambda s, d: rollup.token_counts(_table(s, d, "documents")), rollup.SQL),
    "op11_personal_data": (lambda s, d: pii.personal_data(_table(s, d, "documents")), None),
    "op12_prefix_trie": (lambda s, d: prefixtrie.trie(_table(s, d, "conversations")), prefixtrie.SQL),
    "op13_hard_negatives": (lambda s, d: hardneg.hard_negatives(_table(s, d, "embeddings")), hardneg.SQL),
}
