"""Queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from . import decontaminate, hard_negatives, html_text, lang_id, learned_ann, lm_score, matroska, mixing, ngram_jaccard, packing, periodic, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1,
    "op2_length_buckets": packing.op2,
    "op3_learned_partitions": learned_ann.op3,
    "op4_matroska": matroska.op4,
    "op5_systematic_mix": mixing.op5,
    "op6_toxicity": toxicity.op6,
    "op7_ngram_jaccard": ngram_jaccard.op7,
    "op8_language_id": lang_id.op8,
    "op9_html_blocks": html_text.op9,
    "op10_stupid_backoff": lm_score.op10,
    "op11_periodic_runs": periodic.op11,
    "op12_bit_sliced_negatives": hard_negatives.op12,
    "op13_positional_index": decontaminate.op13,
}
ORACLES = {"op5_systematic_mix": mixing.SQL_MIX.replace("{docs}", "documents"), "op10_stupid_backoff": lm_score.SQL, "op12_bit_sliced_negatives": hard_negatives.SQL, "op13_positional_index": decontaminate.SQL}
