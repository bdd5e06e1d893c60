"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.op10_pii import OP10_SQL, op10_pii
from tessella.llm.op11_importance import OP11_SQL, op11_importance_resampling
from tessella.llm.op12_centroids import OP12_SQL, op12_lloyd
from tessella.llm.op13_substrings import OP13_SQL, op13_fixed_block_anchors
from tessella.llm.op1_style_tree import op1_site_style_tree
from tessella.llm.op2_sharding import op2_lpt_sharding
from tessella.llm.op3_mixing import OP3_SQL, op3_mixing
from tessella.llm.op4_token_planes import op4_bit_planes
from tessella.llm.op5_simhash import op5_pivot_simhash
from tessella.llm.op6_langid import op6_language_id
from tessella.llm.op7_chat import OP7_SQL, op7_budgeted_windows
from tessella.llm.op8_decontamination import OP8_SQL, op8_decontamination
from tessella.llm.op9_media_chunks import op9_media_chunks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_site_style_tree, op2_lpt_sharding, op3_mixing, op4_bit_planes, op5_pivot_simhash, op6_language_id, op7_budgeted_windows, op8_decontamination, op9_media_chunks, op10_pii, op11_importance_resampling, op12_lloyd, op13_fixed_block_anchors]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {"op3_mixing": OP3_SQL, "op7_budgeted_windows": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_pii": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_lloyd": OP12_SQL, "op13_fixed_block_anchors": OP13_SQL}
