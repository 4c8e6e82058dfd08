"""The subpackage's queries and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from letterloom.llm import decontaminate, licenses, linededup, lines, mixing, pipeline, quality, secrets, simhash, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            simhash.op1_simhash_near_dedup,
            decontaminate.op2_benchmark_decontamination,
            quality.op3_quality_classifier,
            toxicity.op4_toxicity,
            tokens.op5_token_counts,
            lines.op6_quality_rules,
            linededup.op7_line_dedup,
            licenses.op8_license_scan,
            secrets.op9_secret_scan,
            mixing.op10_mixing,
        )
    } | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": decontaminate.OP2_SQL,
        "op6_quality_rules": lines.OP6_SQL,
        "op7_line_dedup": linededup.OP7_SQL,
        "op8_license_scan": licenses.OP8_SQL,
        "op9_secret_scan": secrets.OP9_SQL,
    }
