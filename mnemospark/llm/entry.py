"""The queries of this subpackage and their SQL."""

from .audit import OP13_SQL, op13
from .decontaminate import OP10_SQL, op10
from .jaccard import OP1_SQL, op1
from .language import op4
from .lines import OP7_SQL, op7
from .media import op5
from .packing import op11
from .pieces import op6
from .ranked import OP12_SQL, op12
from .resampling import op2
from .substrings import OP3_SQL, op3
from .suffixes import OP9_SQL, op9
from .toxicity import op8

QUERIES = {
    "op1_ngram_jaccard_join": op1,
    "op2_quality_classifier": op2,
    "op3_substring_dedup": op3,
    "op4_language_id": op4,
    "op5_media_columns": op5,
    "op6_sentencepiece": op6,
    "op7_line_dedup": op7,
    "op8_toxicity": op8,
    "op9_suffix_array_dedup": op9,
    "op10_benchmark_decontamination": op10,
    "op11_best_fit_packing": op11,
    "op12_ranked_search": op12,
    "op13_filter_audit": op13,
}

ORACLES = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
