"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from digestlake.llm import (
    decontamination,
    exact_dedup,
    language_id,
    packing,
    pii,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_decontamination": decontamination.op1,
        "op2_simhash_near_dedup": simhash.op2,
        "op3_minimum_bin_slack_packing": packing.op3,
        "op4_warc_splittable": warc.op4,
        "op5_marginal_unigram_language_id": language_id.op5,
        "op6_minimax_sharding": sharding.op6,
        "op7_digest_index_dedup": exact_dedup.op7,
        "op8_boosted_pii": pii.op8,
        "op9_suffix_array_dedup": suffix_dedup.op9,
        "op10_pretoken_token_counts": token_counts.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_template_decontamination": decontamination.OP1_SQL,
        "op7_digest_index_dedup": exact_dedup.OP7_SQL,
    }
