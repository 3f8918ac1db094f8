"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import ORACLE_OP8, op8_ann
from .decontaminate import ORACLE_OP1, op1_decontaminate
from .lexical import ORACLE_OP12, op12_search
from .near_dedup import ORACLE_OP9, op9_near_dedup
from .pii import op11_pii
from .sentencepiece_codec import op7_sentencepiece
from .sharding import ORACLE_OP6, op6_sharding
from .spelling import ORACLE_OP13, op13_spelling
from .substring_dedup import ORACLE_OP3, op3_substring_dedup
from .token_counts import op2_token_counts
from .token_store import op5_token_store
from .toxicity import op4_toxicity
from .warc import ORACLE_OP10, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_store": op5_token_store,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ann": op8_ann,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
    "op11_pii": op11_pii,
    "op12_search": op12_search,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": ORACLE_OP1,
    "op3_substring_dedup": ORACLE_OP3,
    "op6_sharding": ORACLE_OP6,
    "op8_ann": ORACLE_OP8,
    "op9_near_dedup": ORACLE_OP9,
    "op10_warc": ORACLE_OP10,
    "op12_search": ORACLE_OP12,
    "op13_spelling": ORACLE_OP13,
}
