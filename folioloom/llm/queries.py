"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from folioloom.llm import collocations, fingerprints, language_id, license_scan, line_dedup, near_dedup, packing, pieces, prefix_trie, pseudo_likelihood, quality_rules, simhash, token_files

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_pseudo_likelihood": pseudo_likelihood.op5_pseudo_likelihood,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_nbest_pieces": pieces.op7_nbest_pieces,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_token_files": token_files.op9_token_files,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_simhash": simhash.op13_simhash,
}

ORACLES = {
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
