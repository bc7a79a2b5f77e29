"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunking import op4
from .curve import op12
from .decontaminate import OP10_SQL, op10
from .langid import op6
from .lines import OP5_SQL, op5
from .mil import op3
from .minhash import op2
from .packing import op7
from .quality import op8
from .search import OP11_SQL, op11
from .sharding import op1
from .statements import OP2_SQL, OP9_SQL, QUALITY_SQL, SHARDING_SQL, quality_statistics, sharding_audit
from .variants import OP13_SQL, op13
from .warc import op9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1,
    "op2_minhash": op2,
    "op4_substring_dedup": op4,
    "op5_line_dedup": op5,
    "op7_packing": op7,
    "op3_attention_quality": op3,
    "op6_language_id": op6,
    "op8_quality_rules": op8,
    "op9_warc": op9,
    "op10_decontamination": op10,
    "op11_ranked_search": op11,
    "op12_curve_packing": op12,
    "op13_spelling_variants": op13,
    "quality_statistics": quality_statistics,
    "sharding_audit": sharding_audit,
}
ORACLES: dict[str, str] = {
    "op2_minhash": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op9_warc": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
    "quality_statistics": QUALITY_SQL,
    "sharding_audit": SHARDING_SQL,
}
