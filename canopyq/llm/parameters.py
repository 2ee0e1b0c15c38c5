"""Where the registered queries find their tables, and the parameters they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUALITY_THRESHOLD = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
