"""Queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.html_text import op7_html_text
from tessera.llm.language_id import op1_language_id
from tessera.llm.lm import op3_language_model
from tessera.llm.packing import op5_packing
from tessera.llm.pii import op6_pii
from tessera.llm.quality import OP2_SQL, op2_quality_rules
from tessera.llm.quality_score import op13_quality_classifier
from tessera.llm.resampling import OP11_SQL, op11_resampling
from tessera.llm.simhash import op10_simhash
from tessera.llm.syncmers import op9_syncmers
from tessera.llm.token_counts import op8_token_counts
from tessera.llm.vector_codes import OP12_SQL, op12_vector_codes
from tessera.llm.word_bpe import op4_bpe_codec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_model": op3_language_model,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_syncmers": op9_syncmers,
    "op10_simhash": op10_simhash,
    "op11_resampling": op11_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_classifier": op13_quality_classifier,
}
#: DuckDB SQL for those that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op11_resampling": OP11_SQL, "op12_vector_codes": OP12_SQL}
