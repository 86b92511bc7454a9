"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ngramforge.llm import bpe, fingerprint, language, minhash, neighbours, packing, pages, sharding, suffixes, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_text": pages.query,
    "op2_byte_bpe": bpe.query,
    "op3_order_minhash": minhash.query,
    "op4_repeated_passages": suffixes.query,
    "op5_weighted_fingerprints": fingerprint.query,
    "op6_neighbour_graph": neighbours.query,
    "op7_packing": packing.query,
    "op8_wavelet_shards": wavelet.query,
    "op9_language_id": language.query,
    "op10_shards": sharding.query,
}

#: DuckDB SQL for the rows of those that SQL can express.
ORACLES: dict[str, str] = {"op4_repeated_passages": suffixes.ORACLE}
