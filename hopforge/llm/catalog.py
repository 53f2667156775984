"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopforge.llm.chat import OP2_SQL, op2_template_compiler
from hopforge.llm.decontamination import op8_q_gram_lemma
from hopforge.llm.line_dedup import OP5_SQL, op5_perfect_hash_lines
from hopforge.llm.lm_scoring import op10_pseudo_likelihood
from hopforge.llm.packing import op4_sum_of_squares
from hopforge.llm.quality import OP1_SQL, op1_line_frequency
from hopforge.llm.secret_scan import op6_randomness_battery
from hopforge.llm.sharding import OP7_SQL, op7_sampled_splitters
from hopforge.llm.simhash import op3_multi_index
from hopforge.llm.substring_dedup import OP9_SQL, op9_count_min


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_frequency,
        op2_template_compiler,
        op3_multi_index,
        op4_sum_of_squares,
        op5_perfect_hash_lines,
        op6_randomness_battery,
        op7_sampled_splitters,
        op8_q_gram_lemma,
        op9_count_min,
        op10_pseudo_likelihood,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_template_compiler": OP2_SQL,
        "op7_sampled_splitters": OP7_SQL,
        "op1_line_frequency": OP1_SQL,
        "op9_count_min": OP9_SQL,
        "op5_perfect_hash_lines": OP5_SQL,
    }
