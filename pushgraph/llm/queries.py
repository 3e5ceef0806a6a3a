"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pushgraph.llm import decontamination, fim, licenses, line_dedup, mixing, ngram_join, ogg, resampling, secrets, substrings, tokens, toxicity, warc

QUERIES = {
    "op1_ogg_columns": ogg.op1_ogg_columns,
    "op2_ngram_components": ngram_join.op2_ngram_components,
    "op3_secret_ownership": secrets.op3_secret_ownership,
    "op4_contained_items": decontamination.op4_contained_items,
    "op5_resolved_revisits": warc.op5_resolved_revisits,
    "op6_section_tokens": tokens.op6_section_tokens,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_repeated_windows": substrings.op9_repeated_windows,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op2_ngram_components": ngram_join.OP2_SQL,
    "op3_secret_ownership": secrets.OP3_SQL,
    "op4_contained_items": decontamination.OP4_SQL,
    "op5_resolved_revisits": warc.OP5_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_repeated_windows": substrings.OP9_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
}
