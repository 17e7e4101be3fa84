"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .lm_scoring import op3_lm_scoring
from .near_dedup import op8_near_dedup
from .oracles import SQL
from .packing import op2_packing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op10_quality_rules
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op7_token_counts
from .url_filters import op6_url_filters

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
}

__all__ = ["QUERIES", "SQL"]
