"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, divergence, imatch, lang_id, line_dedup, mixing, ngram_join, quality, quality_rules, rolling_median, secrets, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lang_id": lang_id.op1_lang_id,
        "op10_ann": ann.op10_ann,
        "op11_quality_rules": quality_rules.op11_quality_rules,
        "op12_rolling_median": rolling_median.op12_rolling_median,
        "op13_divergence": divergence.op13_divergence,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_bpe_chunks": bpe.op4_bpe_chunks,
        "op5_quality": quality.op5_quality,
        "op6_imatch": imatch.op6_imatch,
        "op7_sharding": sharding.op7_sharding,
        "op8_secrets": secrets.op8_secrets,
        "op9_line_dedup": line_dedup.op9_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op12_rolling_median": rolling_median.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
    }
