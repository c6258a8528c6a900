"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lectern.llm import compact_windows, exact_dedup, html_text, jaccard_join, mixing, packing, secrets, sstable, toxicity, weighted_sampling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sstable": sstable.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_secrets": secrets.query,
        "op4_toxicity": toxicity.query,
        "op5_mixing": mixing.query,
        "op6_compact_windows": compact_windows.query,
        "op7_weighted_sampling": weighted_sampling.query,
        "op8_packing": packing.query,
        "op9_html_text": html_text.query,
        "op10_jaccard_join": jaccard_join.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op5_mixing": mixing.SQL}
