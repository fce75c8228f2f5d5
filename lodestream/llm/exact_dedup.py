"""Exact deduplication by a 128-bit content hash, with a byte comparison inside groups.

Plan: one narrow pass computes (id, code points, MD5 and SHA-256 of the normalised text) and settles it without texts.
Groups of two and more come from a map-side combined aggregation. Only texts of such groups are read for the byte
comparison: their hashes are counted and, up to ``BROADCAST_ROWS``, broadcast to the scan, so unique texts never move;
beyond that a semi join shuffles the texts once. The smallest and the largest text of each group, combined in each task
first, are compared byte for byte; where they differ (a hash collision) the group is split by SHA-256. Hot groups are
safe: all grouping is partially aggregated, and the join that brings the group back to the rows has an exchange on either
side, so adaptive execution splits a hot hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SPACE_CLASS, bounded, read_table, settle, text_or_empty


def normalised(text_col: str) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text_col), f"[{SPACE_CLASS}]+", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _collided(df: DataFrame, text_col: str, hashed: Callable[[Column], Column], parts: list[str], groups: DataFrame) -> DataFrame:
    """Keys of groups that hold more than one normalised text, from a comparison of the bytes of all texts in ``groups``.

    The smallest and the largest text of a group are found in each task first, so a hot group sends one pair a task.
    """
    norm = normalised(text_col)
    sha = F.sha2(norm, 256) if "_ls_sha" in parts else F.lit(None).cast("string")
    texts = df.select(norm.alias("_ls_norm"), hashed(norm).alias("_ls_hash"), sha.alias("_ls_sha")).join(bounded(groups), "_ls_hash", "left_semi")
    return texts.groupBy(*parts).agg(F.min("_ls_norm").alias("_ls_lo"), F.max("_ls_norm").alias("_ls_hi")).where("_ls_lo != _ls_hi").select(*parts)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, plus ``n_points`` and ``content_hash``.

    The row with the most code points stays, then the smallest id, a null id last. Null text counts as empty, so all
    null, empty and blank texts are one group. Rows that agree in id and text too are still one row each, and exactly one
    of them is kept. An empty table gives an empty result. Other columns of ``df`` are not read. ``hashed`` may be
    replaced, as tests do to force collisions.
    """
    norm = normalised(text_col)
    rows = settle(
        df.select(F.col(f"`{id_col}`").alias("_ls_id"), F.length(text_or_empty(text_col)).cast("long").alias("_ls_n"), norm.alias("_ls_norm"))
        .select("_ls_id", "_ls_n", hashed(F.col("_ls_norm")).alias("_ls_hash"), F.sha2("_ls_norm", 256).alias("_ls_sha"))
        .withColumn("_ls_row", F.monotonically_increasing_id())
    )
    best = F.min(F.struct((-F.col("_ls_n")).alias("n"), F.col("_ls_id").isNull().alias("x"), F.col("_ls_id").alias("id"), F.col("_ls_row").alias("row"))).alias("_ls_best")

    def grouped(keyed: DataFrame, parts: list[str]) -> DataFrame:
        return settle(keyed.groupBy(*parts).agg(F.count("*").alias("_ls_size"), best).where("_ls_size > 1"))

    groups = grouped(rows, ["_ls_hash"])
    several = settle(groups.select("_ls_hash"))
    collided = settle(_collided(df, text_col, hashed, ["_ls_hash"], several))
    parts = ["_ls_hash"]
    if not collided.isEmpty():
        marked = rows.join(collided.withColumn("_ls_split", F.lit(True)), "_ls_hash", "left")
        rows = settle(marked.withColumn("_ls_sub", F.when(F.col("_ls_split"), F.col("_ls_sha")).otherwise("")).drop("_ls_split"))
        parts = ["_ls_hash", "_ls_sub"]
        groups = grouped(rows, parts)
        if not _collided(df, text_col, hashed, ["_ls_hash", "_ls_sha"], several).isEmpty():
            raise ValueError("two texts agree in the content hash and in SHA-256")
    out = rows.join(groups, parts, "left")
    alone = F.col("_ls_size").isNull()
    return out.select(
        F.col("_ls_id").alias(id_col),
        F.when(alone, F.col("_ls_id")).otherwise(F.col("_ls_best.id")).alias("keep_id"),
        F.coalesce("_ls_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_ls_best.row") == F.col("_ls_row"))).alias("kept"),
        F.col("_ls_sha").alias("text_sha256"),
        F.col("_ls_n").alias("n_points"),
        F.col("_ls_hash").alias("content_hash"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns unchanged. See ``exact_duplicates`` for which stays.

    Null and repeated ids are decided row by row; an empty table stays empty. The keys of lost rows are broadcast to the
    scan up to ``BROADCAST_ROWS``; beyond that the texts are shuffled once.
    """
    found = settle(exact_duplicates(df, id_col, text_col).select(F.col(id_col).alias("_ls_id"), F.col("n_points").alias("_ls_n"), F.col("content_hash").alias("_ls_hash"), F.col("kept").alias("_ls_kept")))
    parts = ["_ls_id", "_ls_n", "_ls_hash"]
    by_key = settle(found.groupBy(*parts).agg(F.count("*").alias("_ls_rows"), F.max("_ls_kept").alias("_ls_any")).where("not _ls_any or _ls_rows > 1"))
    lost, repeated = (bounded(settle(by_key.where(x).select(*parts))) for x in ("not _ls_any", "_ls_any"))
    names = df.columns
    keyed = df.withColumns({"_ls_n": F.length(text_or_empty(text_col)).cast("long"), "_ls_hash": md5_128(normalised(text_col))})
    same = lambda t: F.col(f"`{id_col}`").eqNullSafe(t["_ls_id"]) & (keyed["_ls_n"] == t["_ls_n"]) & (keyed["_ls_hash"] == t["_ls_hash"])
    left = keyed.join(lost, same(lost), "left_anti")
    if repeated.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in names])
    once = left.join(repeated, same(repeated), "left_anti").select(*[F.col(f"`{c}`") for c in names])
    again = left.join(repeated, same(repeated), "left_semi").withColumn("_ls_id", F.col(f"`{id_col}`")).dropDuplicates(parts)
    return once.unionByName(again.select(*[F.col(f"`{c}`") for c in names]))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""
