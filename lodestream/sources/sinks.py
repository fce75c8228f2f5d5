"""Writers. What replaces rows writes the new table to a path of its own and never over what it reads."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestream.sources.xlsx import write_workbook

FORMATS = ("parquet", "json", "csv", "excel")
EXCEL_ROWS = 1_048_575


def master_file(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The result of a pipeline in one of the declared formats. See ``excel_file`` for the one that is a single file."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind == "excel":
        excel_file({"Sheet1": df}, path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)


def excel_file(sheets: Mapping[str, DataFrame], path: str) -> None:
    """One workbook, a sheet for each frame, put where Spark can write (``path`` is replaced).

    Refused for more rows than a sheet has. Rows are streamed, partition by partition, to one archive and from there to
    ``path``: a workbook is one file, but it is never held in memory.
    """
    spark = next(iter(sheets.values())).sparkSession
    for df in sheets.values():
        if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
            raise ValueError("more rows than a sheet holds; write parquet or csv")
    with tempfile.TemporaryDirectory(prefix="lodestream-") as folder:
        local = f"{folder}/book.xlsx"
        write_workbook(local, [(name, df.columns, df.toLocalIterator()) for name, df in sheets.items()])
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(True, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), where)


def upserted(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``current`` with the rows of ``batch`` put in by key; of several batch rows of a key the first in ``order``."""
    newest = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return current.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest, allowMissingColumns=True)


def inserted_if_absent(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch rows to append: one for each key that ``current`` lacks."""
    return batch.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")


def upsert_counts(current: DataFrame, batch: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """How many rows of a batch are inserted, updated, skipped (repeated in the batch) or bad: one pass, one row."""
    known = current.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn("_n", F.row_number().over(W.partitionBy("_ok", *keys).orderBy(*keys))).join(known, list(keys), "left")
    once = F.col("_ok") & (F.col("_n") == 1)
    return marked.agg(
        F.count_if(once & F.col("_known").isNull()).alias("inserted"),
        F.count_if(once & F.col("_known").isNotNull()).alias("updated"),
        F.count_if(F.col("_ok") & (F.col("_n") > 1)).alias("skipped"),
        F.count_if(~F.col("_ok")).alias("errors"),
    )


def replace_period(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Delete-then-insert for the periods in ``df``: only their partitions are replaced, so reruns agree."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)


def incremented(current: DataFrame, deltas: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counters with their deltas added up by key."""
    total = deltas.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    return current.join(total, list(keys), "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def unexpired(df: DataFrame, time_col: str, now: Column, hours: int) -> DataFrame:
    """What a conditional delete leaves: rows not older than the time to live."""
    return df.where(F.col(time_col) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def snapshot(df: DataFrame, root: str, stamp: str) -> None:
    """A stamped version and ``latest``, both as JSON."""
    df.write.mode("overwrite").json(f"{root}/versions/{stamp}")
    df.write.mode("overwrite").json(f"{root}/latest")


def text_export(df: DataFrame, path: str, sections: Mapping[str, Sequence[str]], section_col: str, order: Sequence[str]) -> None:
    """Tab-separated lines with a header line for each section, in order: the layout of schedule exchange files."""
    out = None
    for name, columns in sections.items():
        rows = df.where(F.col(section_col) == name)
        lines = rows.select(F.lit(name).alias("s"), F.lit(1).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.concat_ws("\t", F.lit("%R"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
        head = df.sparkSession.createDataFrame([(name, 0, "\t".join(["%F", *columns]))], "s string, k int, value string")
        part = head.unionByName(lines, allowMissingColumns=True)
        out = part if out is None else out.unionByName(part)
    out.orderBy("s", "k", *[f"o{i}" for i in range(len(order))]).select("value").write.mode("overwrite").text(path)
