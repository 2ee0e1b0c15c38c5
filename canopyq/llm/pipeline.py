"""A training-data pipeline over documents: filter, deduplicate, decontaminate, pack.

Each stage takes all rows that its predecessor kept, as Parquet, and returns a
DataFrame; all but the last return the columns of documents.

1. quality: documents that the classifier rejects (score below 0.3) go.
2. line_dedup: lines of 40 or more characters in 5 or more documents stay only
   in the largest doc_id; n_chars follows the text.
3. near_duplicates: of each component of links with Jaccard 0.75 or more on
   five-word shingles, the document with the smallest doc_id stays (its rows, if
   several repeat that id; one row, if none has an id).
4. decontamination: documents that hold a benchmark item go.
5. packing: sequences of 1024 ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import shared_folder
from . import decontaminate, line_dedup, ngram_join, packing, quality
from .parameters import QUALITY_THRESHOLD, table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model, QUALITY_THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.rewrite_lines(docs, least_chars=40, least_docs=5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, percent=75, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), least=0.75)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(docs, tokenizer_path(), size=1024, end_id=0)
    return out.select("doc_id", "start", "length", packing.crc32_column("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again.

    A stage's table goes once the next is written; the last one, which the result
    reads, stays.
    """
    docs = table(spark, sf_dir, "documents")
    base, written = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            at = f"{base}/{i}-{name}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if written:
                _remove(spark, written)
            written = at
    return docs
