"""The normalisers on streams: they keep no state, so each batch is like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.cases import TELEMETRY


def raw_stream(spark: SparkSession, folder: str, modality: str) -> DataFrame:
    """Raw rows of one kind as files arrive; they carry case_id and row_ord."""
    schema = f"case_id string, row_ord long, {TELEMETRY[modality]}"
    return spark.readStream.schema(schema).parquet(folder)


def write_observations(raw: DataFrame, normalise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Append each batch's observations to ``path``; a batch that is repeated replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        normalise(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
