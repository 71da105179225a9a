"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .lm import op3_lm_score
from .mixing import OP4_SQL, op4_mix_sources
from .neardup import OP2_SQL, op2_near_duplicates
from .quality_classifier import op6_quality
from .quality_rules import op5_quality_rules
from .suffixes import op9_repeats
from .token_counts import op10_token_counts
from .topk import OP7_SQL, op7_top_k
from .warc import OP8_SQL, op8_warc_revisits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_near_duplicates, op3_lm_score, op4_mix_sources, op5_quality_rules, op6_quality, op7_top_k, op8_warc_revisits, op9_repeats, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2_SQL, "op4_mix_sources": OP4_SQL, "op7_top_k": OP7_SQL, "op8_warc_revisits": OP8_SQL}
