"""Queries of the training-data operators, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from .decontamination import op6_benchmark_decontamination
from .line_dedup import ORACLE_OP9, op9_line_dedup
from .neighbours import op10_nn_descent
from .ngram_join import ORACLE_OP2, op2_ngram_jaccard_join
from .packing import op7_best_fit_packing
from .quality import op5_quality_classifier
from .secrets import op8_secret_scan
from .toxicity import op1_toxicity
from .url_filters import ORACLE_OP3, op3_url_filters
from .warc import ORACLE_OP4, op4_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_url_filters": op3_url_filters,
    "op4_warc": op4_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_nn_descent": op10_nn_descent,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": ORACLE_OP2,
    "op3_url_filters": ORACLE_OP3,
    "op4_warc": ORACLE_OP4,
    "op9_line_dedup": ORACLE_OP9,
}
