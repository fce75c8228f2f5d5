"""The corpus pipeline: every stage works on all that the stage before it kept.

SQL can express neither the learned toxicity scores nor XXH64 fingerprints, so ``ORACLE_SQL`` is None and the tests hold
the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.bpe import bpe_encode
from lodestream.llm.common import finished, read_table
from lodestream.llm.exact_dedup import drop_exact_duplicates
from lodestream.llm.mixing import mixed_documents
from lodestream.llm.simhash import drop_near_duplicates
from lodestream.llm.toxicity import drop_toxic, fit


#: Rows and bytes that a Python worker gets at once, at most: with whole texts and their shingle sets the defaults of 10,000
#: rows and 64 MB are hundreds of megabytes a task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8_000_000}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the stages, which their caller runs; a smaller setting in plain digits stays."""
    for name, most in BATCH.items():
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts toxic go. It learns from the labels of ``sf_dir`` that meet these documents."""
    small_batches(spark)
    return drop_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of the text that they decode to."""
    small_batches(spark)
    out = bpe_encode(docs, decode=True)
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = finished(spark, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
