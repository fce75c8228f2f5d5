"""Tables in parts (days, hash buckets) that are changed by copy on write.

``data/v=<n>/part=<p>`` holds what change ``n`` wrote, and ``manifest/v=<n>`` says for every part which change its live files
are of. A change writes the parts that it touches and a new manifest; files of other parts are neither read nor written. A
reader goes by one manifest, so it sees a change whole or not at all; a change that is made again overwrites its own files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part string, version bigint"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master without that setting gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def deleted(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _place(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The changes whose manifest is complete, oldest first."""
    found = [int(n[2:]) for n in names(spark, f"{root}/manifest") if n.startswith("v=")]
    return sorted(v for v in found if exists(spark, f"{root}/manifest/v={v}/_SUCCESS"))


def live_parts(spark: SparkSession, root: str, version: int | None = None) -> dict[str, int]:
    """Part -> the change whose files are live, as of a change (the newest by default). Parts are few, whatever the rows are."""
    if version is None:
        version = max(versions(spark, root), default=-1)
    if version < 0 or not exists(spark, f"{root}/manifest/v={version}/_SUCCESS"):
        return {}
    return {r["part"]: r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={version}").collect()}


def read_parts(spark: SparkSession, root: str, schema: StructType, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
    """The live rows, or those of some parts, with their ``part``."""
    live = live_parts(spark, root, version)
    wanted = live if parts is None else {p: live[p] for p in set(parts) if p in live}
    if not wanted:
        return spark.createDataFrame([], schema).withColumn("part", F.lit(None).cast("string"))
    by_version: dict[int, list[str]] = {}
    for part, at in wanted.items():
        by_version.setdefault(at, []).append(part)
    out = None
    whole = StructType([*schema.fields, *StructType().add("part", "string").fields])
    for at, found in sorted(by_version.items()):
        base = f"{root}/data/v={at}"
        rows = spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/part={p}" for p in sorted(found)])
        out = rows if out is None else out.unionByName(rows)
    return out


def replace_parts(rows: DataFrame, root: str, version: int, touched: Iterable[str], before: int) -> None:
    """Make change ``version``: the ``touched`` parts now hold ``rows`` (with their ``part``), others what they held after
    change ``before``. Parts are names that are fit for a path. A touched part without rows goes."""
    spark = rows.sparkSession
    data = f"{root}/data/v={version}"
    rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(data)
    live = {p: v for p, v in live_parts(spark, root, before).items() if p not in set(touched)}
    live |= {n[5:]: version for n in names(spark, data) if n.startswith("part=")}
    spark.createDataFrame(sorted(live.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version}")


def drop_unused(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete what only manifests older than the newest ``keep`` need: those readers are gone."""
    found = versions(spark, root)
    used: set[tuple[str, int]] = set()
    for v in found[-keep:]:
        used |= set(live_parts(spark, root, v).items())
    for v in found[:-keep]:
        deleted(spark, f"{root}/manifest/v={v}")
    newest = found[-1] if found else -1
    for name in names(spark, f"{root}/data"):
        at = int(name[2:])
        if at > newest:
            continue  # a change that is being made
        for part in names(spark, f"{root}/data/{name}"):
            if part.startswith("part=") and (part[5:], at) not in used:
                deleted(spark, f"{root}/data/{name}/{part}")
        if not any(v == at for _, v in used):
            deleted(spark, f"{root}/data/{name}")
