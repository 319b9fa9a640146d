"""The llm queries and their SQL, by name."""

from __future__ import annotations

from pairforge.llm import bpe_speculate, circulant_minhash, cover_tree, edit_match, hash_tree, license_scan, line_templates, norm_buckets, quality_fm, randomness, soft_mixing, toxicity, turn_repair

QUERIES = {
    "op1_cover_tree_topk": cover_tree.op1_cover_tree_topk,
    "op2_circulant_minhash": circulant_minhash.op2_circulant_minhash,
    "op3_template_tree": line_templates.op3_template_tree,
    "op4_hash_tree_shards": hash_tree.op4_hash_tree_shards,
    "op5_pigeonhole_matches": edit_match.op5_pigeonhole_matches,
    "op6_factorisation_machine": quality_fm.op6_factorisation_machine,
    "op7_license_digests": license_scan.op7_license_digests,
    "op8_soft_mixing": soft_mixing.op8_soft_mixing,
    "op9_randomness_battery": randomness.op9_randomness_battery,
    "op10_counterfactual_toxicity": toxicity.op10_counterfactual_toxicity,
    "op11_speculative_bpe": bpe_speculate.op11_speculative_bpe,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_norm_buckets": norm_buckets.op13_norm_buckets,
}

SQL = {
    "op1_cover_tree_topk": cover_tree.sql(),
    "op2_circulant_minhash": circulant_minhash.sql(),
    "op3_template_tree": line_templates.sql(),
    "op4_hash_tree_shards": hash_tree.sql(),
    "op7_license_digests": license_scan.sql(),
    "op9_randomness_battery": randomness.sql(),
    "op12_turn_repair": turn_repair.sql(),
    "op13_norm_buckets": norm_buckets.sql(),
}
