"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, verified Hamming distance.

A fingerprint has four blocks of 16 bits. Two fingerprints that differ in at most two bits agree in at least two blocks,
so they meet under at least one of the six pairs of blocks (32-bit keys). Rows with equal fingerprints are one node.
Keys with one fingerprint are dropped after a counted, partially aggregated pass. A key with many fingerprints is cut
into chunks by hash; every pair of chunks is its own small unit of work, so no task holds a whole hot key and no pair is
lost. Inside a unit the pairs are compared in arrays and only a spanning forest of the verified pairs leaves the task.

``drop_near_duplicates`` has settings of its own: sets of five-word shingles with Jaccard similarity of at least 0.8. At
0.8 about 15 % of SimHash bits differ, too many for the blocks of 64 bits. So its fingerprints have ``NEAR_WORDS`` words of
64 bits, whose every 16 bits are a block: 7 % of the blocks of a pair at 0.8 agree, and 0.997 of such pairs agree in one of
the 80. Those that meet and differ in at most ``NEAR_BITS`` of the first 128 bits are candidates (19 differ at 0.8, 64 by
chance), and every link is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import md5
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lodestream.llm.common import bounded, components, finished, parts, read_table, settle, sorted_runs, spanning_edges, text_or_empty

BLOCKS, BLOCK_BITS, SHARED = 4, 16, 2
CHUNK = 1024
NEAR_WIDTH, NEAR_LEAST = 5, (4, 5)
NEAR_WORDS, NEAR_BITS = 20, 36
CHUNK_SHINGLES = 200_000
_PLUS = np.random.default_rng(42).integers(0, 1 << 64, size=NEAR_WORDS, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> bytes:
    """The 8 bytes (big endian) of one text's fingerprint: majority of the XXH64 bits of its word shingles; no word: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    hashes = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), dtype=np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(_ls_id, _ls_fp): the fingerprint as a signed 64-bit integer of every row; null text counts as empty."""
    kept = df.select(F.col(f"`{id_col}`").alias("_ls_id"), text_or_empty(text_col).cast("binary").alias("_ls_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = b"".join(fingerprint(t.as_py(), width) for t in batch.column(1))
            values = np.frombuffer(found, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["_ls_id", "_ls_fp"])

    return kept.mapInArrow(run, f"_ls_id {kept.schema[0].dataType.simpleString()}, _ls_fp bigint")


def _close_rows(table: pa.Table, order: list[str], words: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in units sorted by ``order``, which ends in (lo, hi), pairs of places in one unit whose ``words`` differ in at
    most ``distance`` bits; of large units, as many as join what all of them join."""
    columns = [table[c].to_numpy() for c in order]
    lo, hi, chunk = columns[-2], columns[-1], table["chunk"].to_numpy()
    new = np.r_[True, np.zeros(len(lo) - 1, dtype=bool)]
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(lo)])
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    unit = np.repeat(np.arange(len(start)), size)
    # Short runs, all at once: each row against the row s places on.
    short = np.repeat(size <= 64, size)
    for s in range(1, int(min(64, size.max()))):
        at = np.flatnonzero(short[:-s] & (unit[s:] == unit[:-s]))
        if not len(at):
            break
        at = at[sum(np.bitwise_count(x[at] ^ x[at + s]) for x in words) <= distance]
        left.append(at)
        right.append(at + s)
    for b, n in zip(start[size > 64], size[size > 64]):
        mine, c = [x[b : b + n] for x in words], chunk[b : b + n]
        crossing = lo[b] != hi[b]
        pair_a, pair_b = [], []
        for i in range(0, n, 256):
            close = sum(np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) for x in mine) <= distance
            if crossing:
                close &= c[i : i + 256, None] != c[None, :]
            p, q = np.nonzero(close)
            p += i
            pair_a.append(p[p < q])
            pair_b.append(q[p < q])
        p, q = spanning_edges(np.concatenate(pair_a), np.concatenate(pair_b), int(n))
        left.append(p + b)
        right.append(q + b)
    return np.concatenate(left), np.concatenate(right)


def _verified(distance: int):
    """Over units sorted by (t, key, lo, hi): edges of a spanning forest of the pairs within ``distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ["t", "key", "lo", "hi"]
        for table in sorted_runs(batches, order):
            fp = table["fp"].to_numpy()
            a, b = _close_rows(table, order, [fp.view(np.uint64)], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join exactly what pairs within ``distance`` bits join."""
    if distance > BLOCKS - SHARED:
        raise ValueError(f"blocks guarantee a shared pair only up to {BLOCKS - SHARED} differing bits")
    block = lambda i: F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), BLOCK_BITS).bitwiseOR(block(j)).alias("key")) for t, (i, j) in enumerate(combinations(range(BLOCKS), SHARED))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    counts = settle(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = rows.join(counts, ["t", "key"]).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    units = met.withColumn("other", other).select("t", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp")
    return units.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi").mapInArrow(_verified(distance), "a bigint, b bigint")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id linked directly or by way of others).

    Null and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are always linked. A
    null id is never the smallest unless a component has no other. An empty table gives an empty result; other columns
    are not read; repeated rows are each returned.
    """
    rows = settle(fingerprints(df, id_col, text_col, width))
    fps = settle(rows.groupBy(F.col("_ls_fp").alias("fp")).agg(F.min("_ls_id").alias("least")))
    roots = components(fingerprint_links(fps.select("fp"), distance))
    placed = settle(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = settle(placed.join(lowest, "root").select("fp", "component_id"))
    return rows.join(by_fp, F.col("_ls_fp") == F.col("fp")).select(
        F.col("_ls_id").alias(id_col), F.lower(F.lpad(F.hex("_ls_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes, width: int = NEAR_WIDTH) -> np.ndarray:
    """The distinct XXH64 hashes, sorted, of one text's word shingles; of fewer words or none, the hash of the whole."""
    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(42))), dtype="<u8"))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The ``NEAR_WORDS`` words of a shingle set's fingerprint: majority of the bits of as many hashes of its shingles; where
    half are 1, the bit of the smallest shingle."""
    ones = np.zeros(64 * NEAR_WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 255):
        # One hash after another out of the XXH64 of a shingle.
        z = shingles[at : at + 255, None] + _PLUS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1)
        if not at:
            first = bits[0]
        # 255 ones fit a byte.
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + first > len(shingles)).view(np.uint64)


def block_keys(words: np.ndarray) -> list[int]:
    """One key for each block of a wide fingerprint."""
    blocks = words.view(np.uint16).astype(np.int64)
    return (blocks | np.arange(len(blocks)) << BLOCK_BITS).tolist()


def _alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` in common reach the similarity."""
    return NEAR_LEAST[1] * shared >= NEAR_LEAST[0] * (a + b - shared)


def _shingled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_md5, digest, n, keys, near0, near1, shingles) of every row; null text counts as empty."""
    text = text_or_empty(text_col).cast("binary")
    kept = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), _text_md5(text_col).alias("text_md5"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 3):
            sets = [shingle_set(t.as_py()) for t in batch.column(3)]
            packed = [x.tobytes() for x in sets]
            prints = [wide_fingerprint(x) for x in sets]
            columns = [
                *batch.columns[:3],
                pa.array([md5(x).digest() for x in packed], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                # So few shingles are like no others: three of four are less than 0.8.
                pa.array([block_keys(p) if len(x) >= NEAR_LEAST[0] else [] for p, x in zip(prints, sets)], pa.list_(pa.int64())),
                *(pa.array(np.array([p[i] for p in prints], dtype=np.uint64).view(np.int64)) for i in (0, 1)),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "text_md5", "digest", "n", "keys", "near0", "near1", "shingles"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"row bigint, id {kind}, text_md5 binary, digest binary, n bigint, keys array<bigint>, near0 bigint, near1 bigint, shingles binary")


def _pairs_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, x, y), those whose shingle sets x and y are alike."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            u, v = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
            keep.append(bool(_alike(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v))))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _units_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over units sorted by (key, lo, hi): alike pairs of different roots, as far as the unit has not joined them yet."""
    for table in sorted_runs(batches, ["key", "lo", "hi"], 500):
        key, lo, hi, node, root = (table[c].to_numpy() for c in ("key", "lo", "hi", "node", "root"))
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        left, right = [], []
        for b, e in zip(start, np.r_[start[1:], len(key)]):
            group = np.unique(root[b:e], return_inverse=True)[1]
            if not group.any():
                continue
            sets = [np.frombuffer(x.as_py(), dtype="<u8") for x in table["shingles"].slice(b, e - b)]
            size = np.array([len(x) for x in sets])
            first = np.r_[0, np.cumsum(size)]
            values, rank = np.unique(np.concatenate(sets), return_inverse=True)
            for i in range(e - b - 1):
                others = group[i + 1 :] != group[i]
                if not (others & _alike(np.minimum(size[i + 1 :], size[i]), size[i + 1 :], size[i])).any():
                    continue
                mine = np.zeros(len(values), dtype=bool)
                mine[rank[first[i] : first[i + 1]]] = True
                shared = np.add.reduceat(mine[rank[first[i + 1] :]], first[i + 1 : -1] - first[i + 1], dtype=np.int64)
                for j in i + 1 + np.flatnonzero(others & _alike(shared, size[i + 1 :], size[i])):
                    if group[i] != group[j]:
                        left.append(node[b + i])
                        right.append(node[b + j])
                        group[group == group[j]] = group[i]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _groups_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over units sorted by (key, lo, hi, node): of each unit the rows that pairs within ``NEAR_BITS`` join, with the smallest
    node that they join, itself included."""
    order = ["key", "lo", "hi"]
    for table in sorted_runs(batches, order):
        words = [table[c].to_numpy().view(np.uint64) for c in ("near0", "near1")]
        at, root = spanning_edges(*_close_rows(table, order, words, NEAR_BITS), table.num_rows)
        if len(at):
            first = np.unique(root)
            node = table["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[np.r_[at, first]]), pa.array(node[np.r_[root, first]])], names=["node", "key"])


def close_groups(nodes: DataFrame) -> DataFrame:
    """(node, key): the groups of ``nodes`` (node, keys, near0, near1) that share a block and are joined by fingerprints
    within ``NEAR_BITS``, each under its smallest node; groups with the same smallest node are one, and list a node once.

    Keys of many nodes are cut into chunks, every two of which are a unit; nodes that only share a block leave no unit.
    """
    rows = nodes.select("node", "near0", "near1", F.explode("keys").alias("key"))
    hot = bounded(settle(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > CHUNK)))
    chunks = F.coalesce(F.ceil(F.col("rows") / CHUNK), F.lit(1)).cast("int")
    mine = rows.join(hot, "key", "left").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    order = ["key", "lo", "hi"]
    units = mine.withColumn("other", other).select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "near0", "near1")
    return units.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_groups_close, "node bigint, key bigint").distinct()


def similar_links(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """Edges (a, b) that join at least what the alike pairs in a common one of the ``close_groups`` of ``nodes`` join.

    ``shingles`` (node, n, shingles) has their sets; only those of nodes in groups are moved. Groups that share nodes are
    compared as one, so a node and its set are in one group, and no list of pairs is made.
    """
    groups = settle(components(settle(close_groups(nodes).where("node != key")), "node", "key"))
    # Lists of nodes that are small, as counted, go to where the sets are; else the sets are shuffled.
    sets = settle(shingles.join(bounded(groups), "node").select("root", "node", "n", "shingles"))
    large = bounded(settle(sets.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > CHUNK_SHINGLES).select("root")))
    zero = F.lit(0)
    small = sets.join(large, "root", "left_anti").select(F.col("root").alias("key"), zero.alias("lo"), zero.alias("hi"), "node", F.col("node").alias("root"), "shingles")
    links = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_units_alike, "a bigint, b bigint")
    return links if large.isEmpty() else links.unionByName(_large_groups_alike(sets.join(large, "root", "left_semi")))


def _large_groups_alike(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join what the alike pairs in each group of ``sets`` (root, node, n, shingles) join.

    The nodes of a group are first checked against its smallest. Those that this leaves are then compared with one another
    and with the rest, pair by pair, in units of two chunks of bounded size.
    """
    firsts = sets.where("node = root").select("root", F.col("shingles").alias("x"))
    both = sets.where("node != root").join(firsts, "root").select(F.col("root").alias("a"), F.col("node").alias("b"), "x", F.col("shingles").alias("y"))
    stars = settle(both.mapInArrow(_pairs_alike, "a bigint, b bigint"))
    joined = stars.select(F.col("b").alias("node"), F.lit(True).alias("joined"))
    placed = settle(sets.select("root", "node", "n").join(joined, "node", "left").withColumn("joined", F.col("joined").isNotNull() | (F.col("node") == F.col("root"))))
    chunks = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / CHUNK_SHINGLES).cast("int")
    left = settle(placed.groupBy("root").agg(chunks(~F.col("joined")).alias("open"), chunks(F.col("joined")).alias("rest")).where("open > 0"))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit("near"), "node"), n).cast("int")
    mine = placed.join(left, "root").withColumn("chunk", F.when(F.col("joined"), F.col("open") + dealt(F.col("rest"))).otherwise(dealt(F.col("open"))))
    # Chunks of nodes that are left meet all chunks, those of joined nodes only them.
    other = F.explode(F.sequence(F.lit(0), F.col("open") - 1 + F.when(F.col("joined"), 0).otherwise(F.col("rest"))))
    units = mine.withColumn("other", other).select(
        F.col("root").alias("key"), F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", F.when(F.col("joined"), F.col("root")).otherwise(F.col("node")).alias("root")
    )
    order = ["key", "lo", "hi"]
    compared = units.join(sets.select("node", "shingles"), "node").select(*order, "node", "root", "shingles").repartition(*order).sortWithinPartitions(*order)
    return stars.unionByName(compared.mapInArrow(_units_alike, "a bigint, b bigint"))


def _text_md5(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text_md5, root) of every row: rows of one root are linked, directly or by way of others.

    Links are between sets of ``NEAR_WIDTH``-word shingles with a Jaccard similarity of at least ``NEAR_LEAST`` whose SimHash
    fingerprints share a block. Equal sets are one node, so copies cost one row each. Null and blank texts are equal.
    """
    rows = settle(_shingled(df, id_col, text_col))
    firsts = settle(rows.groupBy("digest").agg(F.min("row").alias("node")))
    # The node of a set is one of its rows.
    nodes = settle(rows.select(F.col("row").alias("node"), "keys", "near0", "near1").join(bounded(settle(firsts.select("node"))), "node", "left_semi"))
    roots = settle(components(similar_links(nodes, rows.select(F.col("row").alias("node"), "n", "shingles"))))
    placed = settle(firsts.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")))
    return rows.select("row", "id", "text_md5", "digest").join(placed, "digest").select("row", "id", "text_md5", "root")


def _decided(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_ls_id, _ls_md5, stays, rows) of ids and texts in components of several rows, where a row of them goes or they repeat."""
    found = settle(near_duplicates(df, id_col, text_col))
    best = settle(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best"), F.count("*").alias("rows")).where("rows > 1"))
    decided = found.join(best, "root").withColumn("stays", F.col("best.row") == F.col("row"))
    return decided.groupBy(F.col("id").alias("_ls_id"), F.col("text_md5").alias("_ls_md5")).agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with, of each component of ``near_duplicates``, the row with the smallest id, a null id last; columns unchanged.

    Rows are told apart by id and text, so rows that only share an id are decided one by one. Null and blank texts are
    equal to one another; an empty table stays empty.
    """
    # Sets and fingerprints go when the list of rows is written.
    by_key = finished(df.sparkSession, partial(_decided, df, id_col, text_col))
    keyed = df.withColumn("_ls_text_md5", _text_md5(text_col))
    same = lambda t: F.col(f"`{id_col}`").eqNullSafe(t["_ls_id"]) & (keyed["_ls_text_md5"] == t["_ls_md5"])
    lost, repeated = (bounded(settle(by_key.where(x).select("_ls_id", "_ls_md5"))) for x in ("not stays", "stays"))
    names = [F.col(f"`{c}`") for c in df.columns]
    out = keyed.join(lost, same(lost), "left_anti")
    if repeated.isEmpty():
        return out.select(*names)
    again = out.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, "_ls_text_md5"])
    return out.join(repeated, same(repeated), "left_anti").select(*names).unionByName(again.select(*names))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))
