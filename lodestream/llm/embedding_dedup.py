"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of a label become one node with a count, so groups of copies cost one row each.
2. A first graph comes from random hyperplanes: nodes are range-sorted by (label, sign code, projection) and compared with
   the next few in that order; the ranges split a crowded code, so no task holds it whole.
3. Rounds of NN-descent: the neighbours and reverse neighbours of a node meet (a join on either end), are compared with
   one another, and whoever is nearer than the worst of a list enters it, until hardly any list changes; then only those
   that links join, until no more links come.
4. A list all of whose places are links is saturated: there may be more. A link to a node whose list is not saturated stands
   in that node's own list, so saturated nodes can only lack links among each other. They, and only they, get lists twice as
   long, with a first graph of their own that looks twice as far, and descend again; those that are saturated even then are
   compared with all others of their label that are, in blocks of bounded size. Only counts and joining links leave a block.
5. Recall is audited against brute force, in blocks, for every vector whose id is divisible by ``AUDIT_EVERY``. If a link
   is missing, another first graph with other hyperplanes is added and the rounds go on; whatever label then still misses
   one is compared exactly, in blocks.

Links are checked in double precision; nothing below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestream.llm.common import components, read_table, settle, sorted_runs, spanning_edges

NEIGHBOURS, TABLES, AHEAD, BEST = 10, 8, 8, 5
#: Saturated lists are doubled up to this length; beyond it blocks are the cheaper exact way.
LONGEST = 40
ROUNDS, FEW_CHANGES, LINK_ROUNDS = 4, 0.005, 12
#: A group is cut into blocks of ``BLOCK`` vectors, up to ``BLOCKS`` of them; then these grow up to ``LARGEST`` vectors.
BLOCK, BLOCKS, LARGEST, STRIP = 256, 64, 16_384, 128
AUDIT_EVERY, ATTEMPTS = 20, 2
BUCKET = 32


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=kind).reshape(-1, dim)


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, part, unit): part is label and dimension, null if the vector links with nothing; unit is 64-bit floats."""
    base = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, unit = [], []
            for label, vector in zip(batch.column(2).to_pylist(), batch.column(3)):
                v = vector.values.to_numpy(zero_copy_only=False) if label is not None and vector.is_valid else np.zeros(0)
                largest = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
                if largest > 0:
                    v = v / largest
                    part.append(f"{len(v)}|{label}")
                    unit.append((v / np.linalg.norm(v) + 0.0).tobytes())
                else:
                    part.append(None)
                    unit.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.string()), pa.array(unit, pa.binary())], names=["row", "id", "part", "unit"])

    return settle(base.mapInArrow(run, f"row bigint, id {base.schema['id'].dataType.simpleString()}, part string, unit binary"))


def _single(unit: str = "unit"):
    """Half the size is enough to find candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(unit)
            small = [np.frombuffer(x.as_py(), dtype=np.float64).astype(np.float32).tobytes() for x in batch.column(at)]
            yield batch.set_column(at, unit, pa.array(small, pa.binary()))

    return run


def _hashed(bits: int, seed: int, tables: int):
    """For each table: the sign code under its hyperplanes, and one more projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            units = [x.as_py() for x in batch.column(2)]
            sizes = np.array([len(u) // 4 for u in units])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(tables, bits + 1, dim)).astype(np.float32)
                x = np.frombuffer(b"".join(units[i] for i in at), dtype=np.float32).reshape(-1, dim)
                for t in range(tables):
                    p = x @ planes[dim][t].T
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(at), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, dtype=np.int32)), batch.column(1).take(pa.array(at)), pa.array(code), pa.array(p[:, bits].astype(np.float64)), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at))],
                        names=["t", "part", "code", "spot", "node", "unit"],
                    )

    return run


def _ahead(ahead: int, few: int):
    """Over rows sorted by (t, part, code, spot): for each row the best ``few`` of the ``ahead`` on either side of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            held = now.slice(max(0, now.num_rows - ahead))
            t, code, node = (now.column(i).to_numpy() for i in (0, 2, 4))
            part = now.column(1).dictionary_encode().indices.to_numpy()
            units = now.column(5)
            n = now.num_rows
            near, other = np.full((n, 2 * ahead), -2.0, dtype=np.float32), np.zeros((n, 2 * ahead), dtype=np.int64)
            lengths = pc.binary_length(units).to_numpy()
            for dim in np.unique(lengths // 4).tolist():
                mine = np.flatnonzero(lengths == 4 * dim)
                x = _matrix(units.take(pa.array(mine)), "<f4", dim)
                for s in range(1, min(ahead, len(mine) - 1) + 1):
                    a, b = mine[:-s], mine[s:]
                    same = (b - a == s) & (t[a] == t[b]) & (part[a] == part[b]) & (code[a] == code[b])
                    k = np.flatnonzero(same)
                    cos = np.einsum("ij,ij->i", x[k], x[k + s])
                    near[a[k], s - 1], other[a[k], s - 1] = cos, node[b[k]]
                    near[b[k], ahead + s - 1], other[b[k], ahead + s - 1] = cos, node[a[k]]
            best = np.argpartition(-near, few, axis=1)[:, :few]
            row = np.repeat(np.arange(n), few)
            cos, to = near[row, best.ravel()], other[row, best.ravel()]
            keep = cos > -1.5
            yield pa.RecordBatch.from_arrays([pa.array(node[row[keep]]), pa.array(to[keep]), pa.array(cos[keep])], names=["a", "b", "cos"])

    return run


def _met(few: int):
    """Over the members of neighbourhoods, sorted by centre: for each member its best ``few`` fellows that beat its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["centre"], 5_000):
            node, worst = table["node"].to_numpy(), table["worst"].to_numpy()
            centre = table["centre"].to_numpy()
            lengths = pc.binary_length(table["unit"]).to_numpy()
            dim = int(lengths[0]) // 4
            start = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
            size = np.diff(np.r_[start, len(centre)])
            if (lengths != lengths[0]).any():  # centres of several dimensions: one group at a time
                groups = [(np.array([s]), int(n)) for s, n in zip(start, size)]
            else:
                groups = [(start[size == n], int(n)) for n in np.unique(size)]
            units = [x.as_py() for x in table["unit"]]
            for at, n in groups:
                if n < 2:
                    continue
                dim = len(units[at[0]]) // 4
                for lo in range(0, len(at), 512):
                    rows = at[lo : lo + 512, None] + np.arange(n)
                    x = np.frombuffer(b"".join(units[i] for i in rows.ravel()), dtype=np.float32).reshape(len(rows), n, dim)
                    cos = x @ x.transpose(0, 2, 1)
                    cos[:, np.arange(n), np.arange(n)] = -2
                    ids = node[rows]
                    cos[(ids[:, :, None] == ids[:, None, :])] = -2
                    cos[cos <= worst[rows][:, :, None]] = -2
                    k = min(few, n - 1)
                    best = np.argpartition(-cos, k - 1, axis=2)[:, :, :k]
                    value = np.take_along_axis(cos, best, axis=2)
                    g, i, j = np.nonzero(value > -1.5)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(ids[g, best[g, i, j]]), pa.array(value[g, i, j])], names=["a", "b", "cos"])

    return run


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each list, ties by node."""
    best = W.partitionBy("a").orderBy(F.col("cos").desc(), "b")
    once = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def first_graph(nodes: DataFrame, count: int, seed: int, ahead: int = AHEAD, few: int = BEST) -> DataFrame:
    """Candidate pairs (a, b, cos) from hyperplane codes of about ``BUCKET`` nodes each, more if it looks further ahead."""
    bits = max(0, int(np.ceil(np.log2(max(1, count) / (BUCKET * ahead / AHEAD)))))
    hashed = settle(nodes.select("node", "part", "unit").mapInArrow(_hashed(min(bits, 40), seed, TABLES), "t int, part string, code bigint, spot double, node bigint, unit binary"))
    order = ["t", "part", "code", "spot"]
    spread = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(_ahead(ahead, few), "a bigint, b bigint, cos float")


def _refined(nodes: DataFrame, graph: DataFrame, through: DataFrame, k: int, few: int) -> DataFrame:
    """One round: the ends of the edges ``through`` that meet in a node are compared, and lists take in who is nearer.

    Only ``k`` of a neighbourhood are sure to hold one that a list of fewer places lacks."""
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-1.0)).alias("worst"))
    known = nodes.select("node", "unit").join(worst.withColumnRenamed("a", "node"), "node", "left").select("node", "unit", F.coalesce("worst", F.lit(-1.0)).cast("float").alias("worst"))
    back = through.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy(F.col("cos").desc(), "a"))).where(F.col("rank") <= k)
    members = through.select(F.col("a").alias("centre"), F.col("b").alias("node")).unionByName(back.select(F.col("b").alias("centre"), F.col("a").alias("node"))).distinct()
    met = members.join(known, "node").select("centre", "node", "worst", "unit").repartition("centre").sortWithinPartitions("centre")
    found = met.mapInArrow(_met(few), "a bigint, b bigint, cos float")
    return settle(_nearest(graph.select("a", "b", "cos", F.lit(1).alias("old")).unionByName(found.withColumn("old", F.lit(0))), k))


def descend(nodes: DataFrame, graph: DataFrame, count: int, threshold: float, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """Refine neighbour lists (a, b, cos, place) until few change, and then along links alone until no list that is not
    saturated gets another link."""
    for _ in range(rounds):
        graph = _refined(nodes, graph, graph, k, max(BEST, k // 2))
        if graph.where("old = 0").count() <= FEW_CHANGES * count * k:
            break
    # Only nodes with links take part from here on, so all other lists stay as they are.
    linked = F.col("cos") >= threshold - 1e-4
    links = graph.where(linked)
    ends = settle(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    mine, own = nodes.join(ends, "node", "left_semi"), ends.withColumnRenamed("node", "a")
    near = graph.join(own, "a", "left_semi")
    for _ in range(LINK_ROUNDS):
        near = _refined(mine, near, near.where(linked), k, k)
        new = near.where((F.col("old") == 0) & linked)
        if new.join(saturated(near, threshold, k).withColumnRenamed("node", "a"), "a", "left_anti").isEmpty():
            break
    columns = ["a", "b", "cos", "old", "place"]
    return settle(graph.join(own, "a", "left_anti").select(*columns).unionByName(near.select(*columns)))


def _checked(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, whose cosine reaches the threshold in double precision."""
    likely = pairs.where(F.col("cos") >= threshold - 1e-4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with_a = likely.join(full.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a")
    both = with_a.join(full.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float(np.dot(np.frombuffer(x.as_py()), np.frombuffer(y.as_py()))) >= threshold for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _block_links(threshold: float):
    """Over units (part, lo, hi): for each node how many vectors of the other side it links with (node, links, null), and
    links that join whatever the unit's links join (node, 0, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["part", "lo", "hi"], 1):
            part, lo, hi, chunk, node, copies = (table[c].to_numpy() for c in ("part", "lo", "hi", "chunk", "node", "copies"))
            start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            for a, b in zip(start, np.r_[start[1:], len(part)]):
                x = np.stack([np.frombuffer(u.as_py()) for u in table["unit"].slice(a, b - a)])
                c, n = chunk[a:b], copies[a:b]
                total = np.zeros(b - a, dtype=np.int64)
                left = right = np.zeros(0, dtype=np.int64)
                for i in range(0, b - a, STRIP):
                    close = x[i : i + STRIP] @ x.T >= threshold
                    close[np.arange(len(close)), np.arange(i, i + len(close))] = False
                    if lo[a] != hi[a]:
                        close &= c[i : i + STRIP, None] != c[None, :]
                    total[i : i + STRIP] = close @ n
                    p, q = np.nonzero(close)
                    left, right = spanning_edges(np.concatenate([left, p + i]), np.concatenate([right, q]), int(b - a))
                ids = np.concatenate([node[a:b], node[a:b][left]])
                other = pa.array(np.concatenate([node[a:b], node[a:b][right]]), mask=np.arange(len(ids)) < b - a)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([total, np.zeros(len(left), dtype=np.int64)])), other], names=["node", "links", "other"])

    return run


def _chunks(n: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / LARGEST), F.least(F.lit(BLOCKS), F.ceil(F.col(n) / BLOCK))).cast("int")


def _chunk(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("chunks")).cast("int")


def in_blocks(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) of all ``nodes`` (part, node, unit, copies) with others of their part, and joining links (a, b)."""
    sizes = settle(nodes.groupBy("part").agg(F.count("*").alias("n")).select("part", _chunks("n").alias("chunks")))
    placed = nodes.join(sizes, "part").withColumn("chunk", _chunk("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = placed.select("part", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "copies", "unit")
    keys = ["part", "lo", "hi"]
    found = settle(units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_links(threshold), "node bigint, links bigint, other bigint"))
    return found.where("other is null").groupBy("node").agg(F.sum("links").alias("links")), found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def saturated(graph: DataFrame, threshold: float, k: int = NEIGHBOURS) -> DataFrame:
    """Nodes (node) whose list is full of links."""
    lists = graph.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("cos").alias("least"))
    return lists.where((F.col("n") >= k) & (F.col("least") >= threshold - 1e-4)).select("node")


def enlarged(small: DataFrame, full: DataFrame, graph: DataFrame, edges: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (node) whose lists are saturated even at ``LONGEST`` places, and all links that lists have, each once.

    Every step doubles the lists of the nodes that are still saturated; who is not has all of its links in its list.
    """
    k, crowded = NEIGHBOURS, settle(saturated(graph, threshold))
    while k < LONGEST and (count := crowded.count()):
        k *= 2
        nodes = settle(small.join(crowded, "node", "left_semi"))
        known = graph.join(crowded.withColumnRenamed("node", "a"), "a", "left_semi").join(crowded.withColumnRenamed("node", "b"), "b", "left_semi")
        start = first_graph(nodes, count, 1000 * k + seed, AHEAD * k // NEIGHBOURS, k).withColumn("old", F.lit(1)).unionByName(known.select("a", "b", "cos", F.lit(1).alias("old")))
        graph = descend(nodes, settle(_nearest(start, k)), count, threshold, k)
        edges = settle(edges.unionByName(_checked(graph, full, threshold)).distinct())
        crowded = settle(saturated(graph, threshold, k))
    return crowded, edges


def counted_links(full: DataFrame, crowded: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links), copies of linked nodes counted, and joining links (a, b): from the lists, and for nodes that are still
    ``crowded`` among each other in blocks of their whole label."""
    among, joining = in_blocks(full.select("part", "node", "unit", "copies").join(crowded, "node", "left_semi"), threshold)
    copies = full.select("node", "copies")
    mark = crowded.withColumn("full", F.lit(True))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marked = both.join(mark.withColumnRenamed("node", "a").withColumnRenamed("full", "fa"), "a", "left").join(mark.withColumnRenamed("node", "b").withColumnRenamed("full", "fb"), "b", "left")
    listed = marked.where("fa is null or fb is null").join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("listed"))
    return copies.join(listed, "node", "left").join(among, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.coalesce("listed", F.lit(0))).cast("long").alias("links")), joining


def true_links(full: DataFrame, threshold: float) -> DataFrame:
    """(part, node, n) of every vector that is asked for (column ``asked``) and has links: brute force over all, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["part", "q", "c"], 1):
            part, q, c, node, copies, ask = (table[x].to_numpy() for x in ("part", "q", "c", "node", "copies", "ask"))
            start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (q[1:] != q[:-1]) | (c[1:] != c[:-1])])
            for a, b in zip(start, np.r_[start[1:], len(part)]):
                x = np.stack([np.frombuffer(u.as_py()) for u in table["unit"].slice(a, b - a)])
                mine = ask[a:b].astype(bool)
                ids, all_ids, y, n = node[a:b][mine], node[a:b][~mine], x[~mine], copies[a:b][~mine]
                for i in range(0, len(ids), STRIP):
                    close = (x[mine][i : i + STRIP] @ y.T >= threshold) & (ids[i : i + STRIP, None] != all_ids[None, :])
                    yield pa.RecordBatch.from_arrays([table["part"].combine_chunks().take(pa.array(np.full(len(close), a))), pa.array(ids[i : i + STRIP]), pa.array((close @ n).astype(np.int64))], names=["part", "node", "n"])

    sizes = settle(full.groupBy("part").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).where("m > 0").select("part", _chunks("n").alias("chunks"), F.ceil(F.col("m") / LARGEST).cast("int").alias("asks")))
    placed = full.join(sizes, "part")
    every = placed.select("part", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("q"), _chunk("audit").alias("c"), "node", "copies", "unit", F.lit(False).alias("ask"))
    spot = F.pmod(F.xxhash64(F.lit("ask"), "node"), F.col("asks")).cast("int")
    asked = placed.where("asked").select("part", spot.alias("q"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "node", "copies", "unit", F.lit(True).alias("ask"))
    keys = ["part", "q", "c"]
    units = every.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(run, "part string, node bigint, n bigint").groupBy("part", "node").agg(F.sum("n").alias("n")).where("n > 0")


def audit(true: DataFrame, links: DataFrame) -> tuple[float | None, int, list[str]]:
    """Mean share of the true links of an audited vector that ``links`` has, null without any; how many true links that
    tests; and the parts that miss one. Parts are labels, whose number does not grow with the rows."""
    share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
    compared = settle(true.join(links, "node", "left").groupBy("part").agg(F.count("*").alias("asked"), F.sum(share).alias("found"), F.sum("n").alias("tested"), F.max((share < 1).cast("int")).alias("missed")))
    row = compared.agg(F.sum("found") / F.sum("asked"), F.coalesce(F.sum("tested"), F.lit(0))).first()
    return row[0], row[1], [r["part"] for r in compared.where("missed = 1").select("part").collect()]


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept, and of the audit recall (null if it met no link) and
    links_tested, the true links that it was measured on.

    Vectors meet only within a label that is not null and a dimension. A vector that is null, empty, zero, or holds a
    null or non-finite component has no links and is its own component. Equal vectors link with one another; rows that
    repeat an id are vectors of their own. An empty table gives an empty result; other columns are not read.
    """
    rows = _rows(df, id_col, vector_col, label_col)
    whole = rows.schema["id"].dataType
    number = F.col("id") if isinstance(whole, IntegralType) else F.xxhash64(F.lit("audit"), "id")
    asked = F.coalesce(F.max(number % AUDIT_EVERY == 0), F.lit(False)).alias("asked")
    full = settle(
        rows.where("part is not null").groupBy("part", "unit").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("id").alias("least"), asked)
    )
    count = full.count()
    small = settle(full.select("node", "part", "unit").mapInArrow(_single(), "node bigint, part string, unit binary"))
    true = settle(true_links(full, threshold))
    graph = None
    for attempt in range(ATTEMPTS):
        start = first_graph(small, count, attempt).withColumn("old", F.lit(1))
        if graph is not None:
            start = start.unionByName(graph.select("a", "b", "cos", "old"))
        graph = descend(small, settle(_nearest(start, NEIGHBOURS)), count, threshold)
        crowded, edges = enlarged(small, full, graph, settle(_checked(graph, full, threshold)), threshold, attempt)
        links, joining = counted_links(full, crowded, edges, threshold)
        links, edges = settle(links), settle(edges.unionByName(joining).distinct())
        recall, tested, doubted = audit(true, links)
        if not doubted:
            break
    if doubted:
        # The exact way for labels in which a link is missing.
        part = F.col("part").isin(doubted)
        exact, joining = in_blocks(full.where(part).select("part", "node", "unit", "copies"), threshold)
        edges = edges.unionByName(joining)
        links = settle(links.join(exact.withColumnRenamed("links", "all"), "node", "left").select("node", F.coalesce("all", "links").alias("links")))
        recall, tested, _ = audit(true, links)
    roots = settle(components(edges))
    placed = settle(full.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = settle(placed.groupBy("root").agg(F.min("least").alias("component")))
    known = settle(placed.join(lowest, "root").join(links, "node").select("node", "component", (F.col("links") + F.col("copies") - 1).alias("n")))
    named = settle(full.select("part", "unit", "node").join(known, "node").select("part", "unit", "component", "n"))
    out = rows.join(named, ["part", "unit"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        F.lit(recall).cast("double").alias("recall"), F.lit(tested).cast("long").alias("links_tested"),
    )


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
