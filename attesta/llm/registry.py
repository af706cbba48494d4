"""Registered queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_formatting
from .decontamination import OP7_SQL, op7_benchmark_decontamination
from .jaccard_join import OP9_SQL, op9_ngram_jaccard_join
from .lexical_search import OP11_SQL, op11_ranked_search
from .licences import OP3_BASE_SQL, op3_license_base, op3_license_scans
from .line_dedup import OP1_FULL_SQL, OP1_SQL, op1_line_dedup, op1_line_dedup_full
from .mixing import OP12_TARGETS_SQL, op12_source_mixing, op12_source_targets
from .pieces import op2_sentencepiece_encoding
from .quality import op10_quality_classifier
from .token_file import op4_token_binary_output
from .topk import OP8_SQL, op8_exact_topk
from .toxicity import op6_toxicity
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece_encoding": op2_sentencepiece_encoding,
    "op3_license_scans": op3_license_scans,
    "op4_token_binary_output": op4_token_binary_output,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_exact_topk": op8_exact_topk,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_mixing": op12_source_mixing,
    "op13_embedding_whitening": op13_embedding_whitening,
    "op1_line_dedup_full": op1_line_dedup_full,
    "op3_license_base": op3_license_base,
    "op12_source_targets": op12_source_targets,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_chat_formatting": OP5_SQL, "op8_exact_topk": OP8_SQL, "op1_line_dedup_full": OP1_FULL_SQL, "op3_license_base": OP3_BASE_SQL, "op7_benchmark_decontamination": OP7_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_source_targets": OP12_TARGETS_SQL}
