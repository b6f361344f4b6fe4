"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from folioforge.llm import bpe, codes, exact_dedup, language, leaks, line_dedup, mixing, mtree, secrets, sharding, simhash, toxicity, trie

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_language": language.op2_language,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mtree": mtree.op6_mtree,
    "op7_secrets": secrets.op7_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_codes": codes.op11_codes,
    "op12_leaks": leaks.op12_leaks,
    "op13_trie": trie.op13_trie,
    "pipeline": corpus_pipeline.run,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE_SQL = {
    "op4_mixing": mixing.SQL,
    "op6_mtree": mtree.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_codes": codes.SQL,
    "op12_leaks": leaks.SQL,
    "op13_trie": trie.SQL,
}
