"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .op1_suffix_dedup import op1_suffix_dedup
from .op2_crf_quality import op2_crf_quality
from .op3_hilbert_shards import op3_hilbert_shards
from .op4_bpe_codec import op4_bpe_codec
from .op5_rlz_dedup import op5_rlz_dedup
from .op6_token_counts import op6_token_counts
from .op7_quality_rules import op7_quality_rules
from .op8_simhash_ball import op8_simhash_ball
from .op9_ppm_scores import op9_ppm_scores
from .op10_template_leaks import op10_template_leaks
from .sql import SQL

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_crf_quality, op3_hilbert_shards, op4_bpe_codec, op5_rlz_dedup, op6_token_counts, op7_quality_rules, op8_simhash_ball, op9_ppm_scores, op10_template_leaks)}

__all__ = ["QUERIES", "SQL"]
