"""Token counts by way of a digest cache.

A text is counted once for each tokenizer, ever: its SHA-256 digest and the digest of the tokenizer (file, library and
release) are looked up in a table of stored counts; only distinct texts that it lacks are encoded, and their counts are
appended to it. The cache is a folder of Parquet files, one subfolder for each tokenizer version; a run adds its files in
one commit, so one that loses executors, or dies, leaves no half batch. Two runs that add the same text do no harm.

Texts are not moved to be looked up. Digests are; then whichever is shorter goes to the texts: the list of digests to encode
in place, or that of all others (repeated texts and those in the cache). Of repeated texts one copy is taken by a partial
aggregation.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import bounded, read_table, readable_text, settle, shared_dir

LIMIT = 1024
#: Characters that are encoded in one call.
PART = 50_000
STORED = "digest binary, n_tokens bigint"
#: A place where byte-level words cannot span: before a space between two characters that are not white space.
BREAK = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the release of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + content).hexdigest()


def _parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts that byte-level words do not span."""
    at = 0
    while len(text) - at > size:
        cut = BREAK.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(4)
def counter(path: str) -> Callable[[str], int]:
    """The function that counts the tokens of one text: ``tokenizers`` for .json, ``sentencepiece`` for .model files."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text, add_bos=False, add_eos=False))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    with open(path, encoding="utf-8") as f:
        content = f.read()
    tool = tokenizers.Tokenizer.from_str(content)
    tool.no_truncation()
    tool.no_padding()
    spec = json.loads(content)
    words = spec.get("pre_tokenizer") or {}
    # Only here is a cut before a word known to change nothing; a special token with a space could span it.
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))

    def count(text: str) -> int:
        return sum(len(e) for e in tool.encode_batch_fast(list(_parts(text)) if plain else [text], add_special_tokens=False))

    return count


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of ``texts`` (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((count(t.as_py()) for t in batch.column(1)), pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, STORED)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The counts that the cache holds, each digest once."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(df: DataFrame, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    ``cache`` is a folder that driver and executors share; without one the run starts an empty cache below
    ``spark.checkpoint.dir``. ``tokenizer`` must be readable at the same path on every executor. Content is normalised as far
    as counts allow: null counts as empty, and bytes that are not UTF-8 become U+FFFD. Ids may be null or repeat; an empty
    table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    path = tokenizer or default_tokenizer()
    folder = f"{(cache or f'{shared_dir(spark)}/lodestream-token-cache-{uuid.uuid4().hex}').rstrip('/')}/version={tokenizer_version(path)}"
    text = readable_text(text_col)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    keys = settle(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    known = settle(keys.groupBy("digest").agg(F.count("*").alias("copies")).join(stored(spark, folder), "digest", "left"))
    alone = (F.col("copies") == 1) & F.col("n_tokens").isNull()
    repeated = (F.col("copies") > 1) & F.col("n_tokens").isNull()
    size = known.agg(F.count_if(alone).alias("alone"), F.count_if(~alone).alias("others"), F.count_if(repeated).alias("repeated")).first()
    missed = []
    if size["alone"]:
        few = size["alone"] <= size["others"]
        listed = bounded(known.where(alone if few else ~alone).select("digest"))
        missed.append(texts.join(listed, "digest", "left_semi" if few else "left_anti").select("digest", "text"))
    if size["repeated"]:
        copies = texts.join(bounded(known.where(repeated).select("digest")), "digest", "left_semi")
        missed.append(copies.groupBy("digest").agg(F.min("text").alias("text")))
    counts = known.where("n_tokens is not null").select("digest", "n_tokens")
    for part in missed:
        fresh = settle(encoded(part, path))
        fresh.write.mode("append").parquet(folder)
        counts = counts.unionByName(fresh)
    return keys.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
