"""Mix sources to target weights, by words.

Every row gets a hash-random key. Within a source the rows lie in ranges of that key; the ranges' sums are added up in
order, then the rows inside each range, which gives the running sum of words of a whole source without ever holding a
source in one task: a source with a third of all rows has proportionally more ranges. A source's budget is met exactly:
whole epochs first, then the rows in key order up to the word where the rest is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.llm.common import SPACE_CLASS, read_table, settle, text_or_empty

WEIGHTS = (5, 2, 1)
RANGE_ROWS = 2000
KEY_SPACE = 65_536


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_ls_source, source_size, rows, target) from one row per source with source_size and rows.

    Weights repeat over the sources by code point, null last. Targets share ``share`` times all sizes by weight; none
    goes beyond ``most`` times its source's size, and the excess is shared again until that holds. With sources by
    rising (cap / weight), those that stop at their cap come first, which gives the fixed point in closed form.
    """
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("_ls_source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    up = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("_ls_source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    after = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    # The level is right at the first source that stays below its cap.
    held = level.withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("final")), F.col("cap"))
    return held.select("_ls_source", "source_size", "rows", target.alias("target"))


def _key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))


def _words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def _part(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _placed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Every row's place in its source: _ls_start (words before it), and the source's whole epochs and the rest to take."""
    rows = settle(
        df.select(
            F.col(f"`{id_col}`").alias("_ls_id"),
            F.col(f"`{source_col}`").cast("string").alias("_ls_source"),
            _words(text_col).alias("size"),
            _key(id_col, seed).alias("_ls_key"),
        )
    )
    sizes = rows.groupBy("_ls_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = settle(source_targets(sizes))
    ranges = F.greatest(F.lit(1), F.least(F.lit(KEY_SPACE), F.ceil(F.col("rows") / RANGE_ROWS)))
    spot = F.conv(F.substring("_ls_key", 1, 4), 16, 10).cast("long")
    ranged = rows.join(targets, rows["_ls_source"].eqNullSafe(targets["_ls_source"])).select(
        rows["*"], "source_size", "target", F.floor(spot * ranges / KEY_SPACE).cast("int").alias("_ls_range"), _part(rows["_ls_source"]).alias("_ls_part")
    )
    ranged = settle(ranged)
    sums = ranged.groupBy("_ls_part", "_ls_range").agg(F.sum("size").alias("_ls_sum"))
    before = W.partitionBy("_ls_part").orderBy("_ls_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(sums.select("_ls_part", "_ls_range", F.coalesce(F.sum("_ls_sum").over(before), F.lit(0)).alias("_ls_before")))
    within = W.partitionBy("_ls_part", "_ls_range").orderBy("_ls_key", F.col("_ls_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = ranged.withColumn("_ls_within", F.sum("size").over(within)).join(offsets, ["_ls_part", "_ls_range"])
    start = F.col("_ls_before") + F.col("_ls_within") - F.col("size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    return running.select("_ls_part", "_ls_key", "_ls_id", "size", "source_size", "target", start.alias("_ls_start"), epochs.alias("_ls_epochs"), rest.alias("_ls_rest"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """One row per input row: id, size (words), source_size, target, taken (words that the mix takes, repeats counted).

    Null text has size 0; null source is a source of its own, the last. Ties of the key are broken by id, then size, so
    reruns agree; rows that agree in all three are interchangeable. An empty table gives an empty result, a corpus
    without words targets of 0. Other columns are not read.
    """
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_ls_rest") - F.col("_ls_start")))
    return _placed(df, id_col, text_col, source_col, seed).select(
        F.col("_ls_id").alias(id_col), "size", "source_size", "target", (F.col("_ls_epochs") * F.col("size") + more).cast("long").alias("taken")
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``df``, columns unchanged, each as often as the mix takes it.

    Texts are never cut: the one document of a source in which its budget ends comes in whole if at least half of it was
    to be taken. Rows that agree in source, id and size are taken alike; rows without words are not taken.

    The prefix sums run over narrow rows; of them one row a source remains, its epochs and the last place in key order that
    is taken once more. Against that every row decides by itself, so texts are not shuffled.
    """
    place = lambda key, i, size: F.struct(key.alias("key"), i.isNull().alias("last"), i.alias("id"), size.alias("size"))
    half = 2 * F.col("_ls_start") + F.col("size") <= 2 * F.col("_ls_rest")
    taken_to = F.max(F.when(half & (F.col("size") > 0), place(F.col("_ls_key"), F.col("_ls_id"), F.col("size"))))
    cuts = settle(_placed(df, id_col, text_col, source_col, seed).groupBy("_ls_part").agg(F.max("_ls_epochs").alias("_ls_epochs"), taken_to.alias("_ls_to")))
    mine = df.withColumns({"_ls_part": _part(F.col(f"`{source_col}`").cast("string")), "_ls_size": _words(text_col), "_ls_key": _key(id_col, seed)})
    once_more = F.coalesce(place(F.col("_ls_key"), F.col(f"`{id_col}`"), F.col("_ls_size")) <= F.col("_ls_to"), F.lit(False))
    copies = F.when(F.col("_ls_size") > 0, F.col("_ls_epochs") + once_more.cast("int")).otherwise(0).cast("int")
    counted = mine.join(cuts, "_ls_part").withColumn("_ls_copies", copies).where("_ls_copies > 0")
    return counted.withColumn("_ls_nth", F.explode(F.sequence(F.lit(1), F.col("_ls_copies")))).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), '42')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM sources
), leveled AS (
  SELECT *, source_size * CAST(2.0 AS DOUBLE) AS cap, source_size * CAST(2.0 AS DOUBLE) / w AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM leveled
), targets AS (
  SELECT source, source_size,
         least(cap, w * (SELECT level FROM levels WHERE level < ratio ORDER BY ratio, level LIMIT 1)) AS target
  FROM levels
), running AS (
  SELECT r.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM running
"""
