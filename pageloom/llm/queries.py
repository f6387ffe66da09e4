"""The queries of the numbered operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .curriculum import OP9_SQL, op9_mixing
from .hnsw import op2_hnsw
from .langmix import op7_language
from .linedist import op5_line_blocks
from .packing import op8_packing
from .ring import op3_sharding
from .rotcodes import OP6_SQL, op6_rotated_codes
from .simhash import op4_simhash
from .token_codes import op1_token_codes
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": op1_token_codes,
    "op2_hnsw": op2_hnsw,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_line_blocks": op5_line_blocks,
    "op6_rotated_codes": op6_rotated_codes,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op6_rotated_codes": OP6_SQL, "op9_mixing": OP9_SQL}
