"""Centroid clustering on whole numbers with Drake's adaptive bounds.

Every vector keeps its centroid, an upper bound of the distance to it, lower bounds of the distances to the few centroids
that come next, and one lower bound for all the rest. When centroids move, bounds are shifted by how far they moved:

* If the upper bound stays below every lower bound, the centroid is certain and no distance is computed.
* Else the distance to the own centroid is computed, then those to the listed centroids whose bound it reaches.
* If it reaches the bound of the rest too, the order cannot be certified and the vector is compared with all centroids.

How many lower bounds are kept adapts to how many were needed, from a quarter of the centroids down to an eighth. Bounds
are rounded outwards and certify only what is strictly nearer, so results, ties included, are those of a full comparison.

A round is one pass over the vectors, which stay where they are; a centroid's sum changes only by the vectors that changed
their centroid. The driver holds nothing but the centroids. States are written to the shared folder, one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import drop_paths, read_table, settle, temporary

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, "1"
#: Components beyond it count as it, so that squared distances fit 64 bits.
LARGEST = 1 << 27
SLICE = 2048
STATE = "x array<int>, was int, cluster int, upper double, near array<int>, lower array<double>, rest double, used int, distance bigint"


def lattice(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, x): vectors of ``dim`` components, none null or non-finite, as whole numbers floor(scale * component)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(vector, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return df.where((F.size(vector) == dim) & finite).select(F.col(f"`{id_col}`").alias("id"), whole.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each of ``x``, a column for each of ``c``."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # every number on the way is a whole one that doubles hold
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + 1e-12) + 1e-9


def _down(v: np.ndarray) -> np.ndarray:
    return v * (1 - 1e-12) - 1e-9


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def scanned(x: np.ndarray, c: np.ndarray, bounds: int) -> dict[str, np.ndarray]:
    """The state of vectors that are compared with all centroids; ties go to the smaller number."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    by = np.sqrt(np.take_along_axis(d, order, axis=1))
    rest = by[:, bounds + 1] if c.shape[0] > bounds + 1 else np.full(len(x), np.inf)
    return {"cluster": order[:, 0], "upper": _up(by[:, 0]), "near": order[:, 1 : bounds + 1], "lower": _down(by[:, 1 : bounds + 1]), "rest": _down(rest)}


def reassigned(x: np.ndarray, c: np.ndarray, moved: np.ndarray, bounds: int, s: dict[str, np.ndarray]) -> np.ndarray:
    """Bring the state ``s`` up to date after the centroids moved to ``c``; returns how many bounds each vector needed."""
    upper = _up(s["upper"] + moved[s["cluster"]])
    lower = _down(s["lower"] - moved[s["near"]])
    rest = _down(s["rest"] - moved.max())
    if lower.shape[1] > bounds:  # fewer bounds from now on: the largest go into that of the rest
        order = np.argsort(lower, axis=1, kind="stable")
        lower, near = np.take_along_axis(lower, order, axis=1), np.take_along_axis(s["near"], order, axis=1)
        rest = np.minimum(rest, lower[:, bounds])
        lower, s["near"] = lower[:, :bounds].copy(), near[:, :bounds].copy()
    s["upper"], s["lower"], s["rest"] = upper, lower, rest
    used = np.zeros(len(x), dtype=np.int64)
    least = np.minimum(lower.min(axis=1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= least)
    own = _own(x[open_], c[s["cluster"][open_]])
    upper[open_] = _up(np.sqrt(own))
    still = upper[open_] >= least[open_]
    open_, own = open_[still], own[still]
    # Those whose listed bounds certify the order: only the listed centroids in reach are compared.
    listed = rest[open_] > upper[open_]
    at, own = open_[listed], own[listed]
    if len(at):
        near, low = s["near"][at], lower[at]
        reach = low <= upper[at, None]
        used[at] = reach.sum(axis=1)
        r, j = np.nonzero(reach)
        d = np.full(near.shape, np.iinfo(np.int64).max)
        d[r, j] = _own(x[at[r]], c[near[r, j]])
        low[r, j] = _down(np.sqrt(d[r, j]))
        best = np.lexsort((near, d), axis=1)[:, 0]
        row = np.arange(len(at))
        found, name = d[row, best], near[row, best]
        wins = (found < own) | ((found == own) & (name < s["cluster"][at]))
        w, b = row[wins], best[wins]
        near[w, b], low[w, b] = s["cluster"][at[w]], _down(np.sqrt(own[wins]))
        s["cluster"][at[w]], upper[at[w]] = name[wins], _up(np.sqrt(found[wins]))
        s["near"][at], lower[at] = near, low
    far = open_[~listed]
    if len(far):
        used[far] = bounds
        for name, value in scanned(x[far], c, bounds).items():
            s[name][far] = value
    return used


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _rows(column: pa.Array, n: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)


def _pass(c: np.ndarray, moved: np.ndarray | None, bounds: int):
    """One assignment of all vectors: the first compares with all centroids, later ones start from their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                n = batch.num_rows
                column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                x = _rows(column["x"], n, np.int64)
                if moved is None:
                    s = scanned(x, c, bounds)
                    was, used = np.full(n, -1), np.full(n, bounds)
                else:
                    s = {k: column[k].to_numpy(zero_copy_only=False).copy() for k in ("cluster", "upper", "rest")}
                    s["near"], s["lower"] = _rows(column["near"], n, np.int64), _rows(column["lower"], n, np.float64)
                    was = s["cluster"].copy()
                    used = reassigned(x, c, moved, bounds, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        column["id"], column["x"], pa.array(was, pa.int32()), pa.array(s["cluster"], pa.int32()), pa.array(s["upper"]), _lists(s["near"], pa.int32()),
                        _lists(s["lower"], pa.float64()), pa.array(s["rest"]), pa.array(used, pa.int32()), pa.array(_own(x, c[s["cluster"]]), pa.int64()),
                    ],
                    names=["id", "x", "was", "cluster", "upper", "near", "lower", "rest", "used", "distance"],
                )

    return run


def _changes(k: int):
    """By how much the vectors that changed their centroid change sums and counts: (cluster, place, total), place -1 the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.c_[np.ones(batch.num_rows, dtype=np.int64), _rows(batch.column(0), batch.num_rows, np.int64)]
            was, now = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            total = np.zeros((k, x.shape[1]), dtype=np.int64)
            np.add.at(total, now, x)
            left = was >= 0
            np.subtract.at(total, was[left], x[left])
            r, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[r, j])], names=["cluster", "place", "total"])

    return run


def centroid_clusters(
    df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """One row per vector of ``dim`` components, none null or non-finite: id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256 (of the final centroid's whole numbers, joined by commas).

    Components x count as floor(scale * x), at most ``LARGEST`` in size. The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``<seed>:<id>`` (null ids last, ties by components; all vectors if there are fewer). Each round
    assigns every vector to its nearest centroid, ties to the smaller number, and replaces centroids that have vectors by
    the floor of their mean; then vectors are assigned once more. Rows that repeat an id are vectors of their own. Without
    a usable vector the result is empty; other columns are not read.
    """
    spark = df.sparkSession
    with temporary(spark) as made:
        state = settle(lattice(df, id_col, vector_col, dim, scale))
        kind = state.schema["id"].dataType.simpleString()
        first = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k)
        c = np.array([r["x"] for r in first.select("x").collect()], dtype=np.int64).reshape(-1, dim)
        n, totals = len(c), np.zeros((len(c), dim + 1), dtype=object)
        bounds, moved = max(1, n // 4), None
        for step in range(rounds + 1 if n else 0):
            state = settle(state.mapInArrow(_pass(c, moved, bounds), f"id {kind}, {STATE}"))
            drop_paths(spark, made[:-1])
            del made[:-1]
            if step == rounds:
                break
            used = state.agg(F.max("used")).first()[0]
            changed = state.where("was != cluster").select("x", "was", "cluster").mapInArrow(_changes(n), "cluster int, place int, total bigint")
            for r in changed.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
                totals[r["cluster"], r["place"] + 1] += int(r["total"])
            old, c = c, np.array([[s // t[0] for s in t[1:]] if t[0] else list(o) for t, o in zip(totals, c)], dtype=np.int64)
            moved = _up(np.sqrt(((c - old) ** 2).sum(axis=1)))
            bounds = max(1, n // 8, min(bounds, used))
        made.clear()  # the last state stays: the lazy result reads it
    if not n:
        empty = ", ".join([f"`{id_col}` {kind}", "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"])
        return spark.createDataFrame([], empty)
    sums = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    named = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    # As many rows as centroids.
    centroids = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return state.join(centroids, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(read_table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Each round spelt out: (c, d, v) holds the components of the centroids, (r, d, x) those of the vectors."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT r, c, sum((x - v) * (x - v)) AS s FROM x JOIN c{i} USING (d) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, c, s FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} AS m USING (c, d))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}
),
x AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept),
f AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v
  FROM kept QUALIFY c < {CENTROIDS}
),
c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS v FROM f),
{(", " + chr(10)).join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance,
       CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (c)"""


OP12_SQL = _op12_sql()
