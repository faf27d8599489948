"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import html_text, language, license_scan, merkle_manifest, mixing, ngram_join, periodic_runs, quality, sentencepiece_fst, tool_calls, toxicity, vector_neardup, window_index

QUERIES = {
    "op1_language_mixture": language.op1_language_mixture,
    "op2_collision_neardup": vector_neardup.op2_collision_neardup,
    "op3_pfair_mix": mixing.op3_pfair_mix,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_toxicity_pu": toxicity.op6_toxicity_pu,
    "op7_tool_links": tool_calls.op7_tool_links,
    "op7_tool_links_all": tool_calls.op7_tool_links_all,
    "op8_quality_cascade": quality.op8_quality_cascade,
    "op9_html_blocks": html_text.op9_html_blocks,
    "op10_window_index": window_index.op10_window_index,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_collision_neardup": vector_neardup.OP2_SQL,
    "op3_pfair_mix": mixing.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op7_tool_links": tool_calls.OP7_SQL,
    "op7_tool_links_all": tool_calls.OP7_ALL_SQL,
    "op8_quality_cascade": quality.OP8_SQL,
    "op10_window_index": window_index.OP10_SQL,
    "op11_periodic_runs": periodic_runs.OP11_SQL,
    "op12_license_scan": license_scan.OP12_SQL,
    "op13_merkle_manifest": merkle_manifest.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
