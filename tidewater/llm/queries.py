"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .near_duplicates import NEAR_DUPLICATES_SQL, op4_near_duplicates
from .nearest import NEAREST_SQL, op7_nearest
from .packing import op10_best_fit_packing
from .passages import op8_passages
from .quality_classifier import op9_quality_classifier
from .quality_rules import op1_quality_rules
from .secrets import op6_secrets
from .source_mix import SOURCE_MIX_SQL, op2_source_mix
from .token_counts import op3_token_counts
from .training_order import op5_training_order

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_training_order": op5_training_order,
    "op6_secrets": op6_secrets,
    "op7_nearest": op7_nearest,
    "op8_passages": op8_passages,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL = {"op2_source_mix": SOURCE_MIX_SQL, "op4_near_duplicates": NEAR_DUPLICATES_SQL, "op7_nearest": NEAREST_SQL}
