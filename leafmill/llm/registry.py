"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import urls
from leafmill.llm.bpe import op3_byte_bpe
from leafmill.llm.fingerprints import op10_edit_fingerprints
from leafmill.llm.near import op7_minhash_join
from leafmill.llm.neighbours import op5_ivf_pq_search
from leafmill.llm.packing import op1_best_fit_packing
from leafmill.llm.quality import op8_rule_quality
from leafmill.llm.sharding import op2_min_cost_flow_sharding
from leafmill.llm.substrings import op4_repeated_passages
from leafmill.llm.token_store import op6_token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_min_cost_flow_sharding": op2_min_cost_flow_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_ivf_pq_search": op5_ivf_pq_search,
    "op6_token_store": op6_token_store,
    "op7_minhash_join": op7_minhash_join,
    "op8_rule_quality": op8_rule_quality,
    "op9_url_rules": urls.op9_url_rules,
    "op10_edit_fingerprints": op10_edit_fingerprints,
}

ORACLES: dict[str, str] = {
    "op9_url_rules": urls.ORACLE,
}
