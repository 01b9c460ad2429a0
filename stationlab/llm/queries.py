"""Registered queries of the subpackage and, where SQL can express them, their SQL."""

from . import exact_dedup, fill_middle, filter_audit, jaccard_join, language, mixing, packing, personal, quality, sentence_spans, \
    token_files, toxicity, vector_search

QUERIES = {
    "op1_skip_chain_crf": personal.op1_skip_chain_crf,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_repair_files": token_files.op3_repair_files,
    "op4_norm_buckets": vector_search.op4_norm_buckets,
    "op5_sentence_spans": sentence_spans.op5_sentence_spans,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_nb_support_vectors": quality.op7_nb_support_vectors,
    "op8_nearest_toxic": toxicity.op8_nearest_toxic,
    "op9_signature_trees": jaccard_join.op9_signature_trees,
    "op10_harmonic_packing": packing.op10_harmonic_packing,
    "op11_boundary_containers": fill_middle.op11_boundary_containers,
    "op12_hyperdimensional_language": language.op12_hyperdimensional_language,
    "op13_filter_diagrams": filter_audit.op13_filter_diagrams,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_norm_buckets": vector_search.SQL,
    "op6_source_mix": mixing.SQL,
    "op9_signature_trees": jaccard_join.SQL,
    "op11_boundary_containers": fill_middle.SQL,
    "op13_filter_diagrams": filter_audit.SQL,
}
