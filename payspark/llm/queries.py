"""The queries of this subpackage by name; ``ORACLE_SQL`` has DuckDB SQL where it expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from payspark.llm.alignment import token_alignment
from payspark.llm.best_fit import best_fit_packing
from payspark.llm.brown_lm import brown_scores
from payspark.llm.chat_tree import chat_tree
from payspark.llm.decontaminate import decontaminate
from payspark.llm.fim import middle_filling
from payspark.llm.license_scan import license_scan
from payspark.llm.line_crf import line_quality
from payspark.llm.packing import packing
from payspark.llm.pii import personal_data
from payspark.llm.rules import quality_rules
from payspark.llm.simhash import simhash
from payspark.llm.sql import ORACLE_SQL  # noqa: F401 - part of this module's interface
from payspark.llm.substrings import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tree": chat_tree,
    "op2_brown_lm": brown_scores,
    "op3_personal_data": personal_data,
    "op4_decontaminate": decontaminate,
    "op5_line_quality": line_quality,
    "op6_substring_dedup": substring_dedup,
    "op7_simhash": simhash,
    "op8_license_scan": license_scan,
    "op9_quality_rules": quality_rules,
    "op10_packing": packing,
    "op11_token_alignment": token_alignment,
    "op12_best_fit_packing": best_fit_packing,
    "op13_middle_filling": middle_filling,
}
