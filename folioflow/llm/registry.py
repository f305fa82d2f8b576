"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_quality, op10_toxicity, op2_bpe, op3_simhash, op4_suffixes, op5_urls, op6_hnsw, op7_packing, op8_warc, op9_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality.op1_quality,
    "op2_byte_bpe": op2_bpe.op2_byte_bpe,
    "op3_simhash": op3_simhash.op3_simhash,
    "op4_suffix_dedup": op4_suffixes.op4_suffix_dedup,
    "op5_url_filter": op5_urls.op5_url_filter,
    "op6_embeddings": op6_hnsw.op6_embeddings,
    "op7_packing": op7_packing.op7_packing,
    "op8_warc": op8_warc.op8_warc,
    "op9_line_dedup": op9_lines.op9_line_dedup,
    "op10_toxicity": op10_toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": op4_suffixes.ORACLE,
    "op6_embeddings": op6_hnsw.ORACLE,
    "op8_warc": op8_warc.ORACLE,
    "op9_line_dedup": op9_lines.ORACLE,
}
