"""Helpers that the training-data operators share.

Internal columns start with ``_ls_`` so that they do not clash with a caller's columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bounds the bytes of texts that a sample brings to the driver.
SAMPLE_BYTES = 64_000_000
#: Up to so many narrow rows may be broadcast, after they were counted; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: The white space of all contracts: space and the five ASCII controls from tab to return.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE = re.compile(f"[{SPACE_CLASS}]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master; on a cluster executors would write where nobody reads,
    so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_settled: dict[int, list[str]] = {}


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and gives the planner true sizes.

    The table stays until the shared folder is cleared, unless it is written within ``temporary`` or ``finished``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _settled.values():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """A settled table of narrow rows, to be broadcast if it was counted to be small; else the join is left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Within this block every settled table is listed; on leaving it all those are deleted.

    What outlives the block must be settled again outside of it, and nothing computed later may read the deleted tables.
    """
    mark = uuid.uuid4().int
    _settled[mark] = []
    try:
        yield _settled[mark]
    finally:
        drop_paths(spark, _settled.pop(mark))


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The settled result of ``make``; the tables that it settled on its way are deleted."""
    with temporary(spark) as made:
        out = settle(make())
        made.pop()
    return out


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def readable_text(text_col: str) -> Column:
    """The text for Python workers: null counts as empty, and bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(text_or_empty(text_col))


def slices(text: str, size: int = 100_000) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end at white space, so that the words of a long one are never
    listed all at once; a run without white space stays whole."""
    at, end = 0, len(text)
    while end - at > size:
        cut = SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def parts(batches: Iterable[pa.RecordBatch], column: int, rows: int = 1000, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` (text or bytes) holds at most about ``size`` bytes in each, a longer value alone.

    What a function makes of a batch is then bounded whatever the session's batch size is.
    """
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) without null labels; of a repeated id, the smallest label."""
    return (
        labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("_ls_id"))
        .agg(F.min(F.col(f"`{label_col}`").cast("int")).alias("_ls_label"))
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES
) -> list[tuple[int, str, int]]:
    """At most ``per_class`` learnable rows of either class, chosen by the hash of the id, as (id, text, label) by id.

    The bounds on rows and bytes make this small enough for the driver at any corpus size. The ids are chosen from labels
    alone; only the chosen ids, whose number is bounded, are broadcast to fetch whole texts.
    """
    usable = one_label(labels, id_col, label_col).where(~held_out("_ls_id"))
    order = F.xxhash64(F.lit("sample"), "_ls_id")
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("_ls_label") == value).orderBy(order, "_ls_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    label = {r["_ls_id"]: r["_ls_label"] for r in chosen.collect()}
    return [(i, text, label[i]) for i, text in texts_of(docs, list(label), chosen.schema["_ls_id"].dataType, id_col, text_col, most_bytes)]


def texts_of(docs: DataFrame, ids: list, id_type: DataType, id_col: str, text_col: str, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str]]:
    """(id, whole text) of a bounded list of ids, by id; of rows that repeat an id, the smallest text.

    Repeats meet in a partial aggregation before anything reaches the driver. Texts come whole, as many as ``most_bytes``
    hold, in the order of the id's hash; those that do not fit are left out.
    """
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], StructType([StructField("_ls_id", id_type)]))
    rows = docs.select(F.col(f"`{id_col}`").alias("_ls_id"), readable_text(text_col).alias("_ls_text")).join(F.broadcast(wanted), "_ls_id")
    one = settle(rows.groupBy("_ls_id").agg(F.min("_ls_text").alias("_ls_text")))
    # A bounded number of rows: their lengths are added up in one window.
    room = F.sum(F.octet_length("_ls_text").cast("long")).over(W.orderBy(F.xxhash64(F.lit("sample"), "_ls_id"), "_ls_id"))
    fits = one.select("_ls_id", room.alias("room")).where(F.col("room") <= most_bytes).select("_ls_id")
    return sorted((r["_ls_id"], r["_ls_text"]) for r in one.join(F.broadcast(fits), "_ls_id").collect())


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Cut a stream of batches sorted by ``keys`` into tables that never split a run of equal keys.

    What is held back is one run and at most ``rows`` more rows, so memory is bounded by the longest run, which callers bound.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            values = table[k].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            continue
        cut = int(cuts[-1]) + 1
        yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star forest that joins what the edges (a, b) on nodes 0..n-1 join; at most n - 1 of them."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list as (node, root), root the smallest node reachable; nodes without edges are absent.

    Alternates large-star and small-star contractions. Each round is two joins and aggregations over the edges, which
    never grow in number beyond the first symmetric list; each round is written to the shared folder, so a lost executor
    costs one round. No node or component passes through the driver, only the counts that tell when to stop.
    """
    spark = edges.sparkSession

    def contracted(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Large star: every larger neighbour of u points at the smallest of u's neighbourhood.
        large = settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        # Small star: u and its smaller neighbours point at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    pairs = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        pairs = finished(spark, partial(contracted, pairs))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Roots are nodes too: they point at themselves.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def keep_listed(df: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """``df`` without the rows whose id is in ``lost`` (column ``_ls_id``); a null id is never lost. Columns stay as they are."""
    return df.join(lost.select("_ls_id").where("_ls_id is not null"), F.col(f"`{id_col}`") == F.col("_ls_id"), "left_anti")
