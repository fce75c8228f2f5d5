import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestream.llm import embedding_dedup, simhash
from lodestream.llm.common import components, sorted_runs, spanning_edges
from lodestream.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r)
    return {k: min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for k, g in groups.items()}, {k: len(g) for k, g in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(awkward, weak):
    hashed = {"hashed": lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)} if weak else {}  # a weak hash forces collisions
    rows = awkward.collect()
    keep, size = brute_exact(rows)
    text = defaultdict(list)
    for r in rows:
        text[r["doc_id"]].append(norm(r["text"]))
    sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in keep}
    out = exact_duplicates(awkward, **hashed).collect()
    assert len(out) == len(rows)
    for r in out:
        key = sha[r["text_sha256"]]
        assert key in text[r["doc_id"]] and r["keep_id"] == keep[key] and r["group_size"] == size[key]
    assert sum(r["kept"] for r in out) == len(keep)


def test_drop_exact_duplicates_keeps_columns_and_one_row_a_group(awkward, empty):
    out = drop_exact_duplicates(awkward)
    assert out.columns == awkward.columns and out.count() == len(brute_exact(awkward.collect())[0])
    assert drop_exact_duplicates(empty).count() == 0 and exact_duplicates(empty).count() == 0


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, awkward, empty):
    some = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in some.collect()}
    found = {r["doc_id"]: r for r in simhash.simhash_groups(some).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    assert {i: r["component_id"] for i, r in found.items()} == brute_components(prints)
    assert simhash.simhash_groups(awkward).count() == awkward.count() and simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("chunk", [4, 1024])
def test_fingerprint_links_join_all_close_pairs_also_in_hot_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = np.random.default_rng(3)
    centre = int(draw.integers(0, 1 << 62))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (150, 2))}  # one hot family
    far = set(draw.integers(0, 1 << 62, 100).tolist())
    prints = sorted(near | far)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(fps)).collect()}
    expected = brute_components(dict(zip(signed, prints)))
    assert {p: roots.get(p, p) for p in signed} == {i: min(j for j in signed if expected[j] == expected[i]) for i in signed}


def test_drop_near_duplicates_leaves_one_of_each_group(awkward):
    once = awkward.where("doc_id is not null")
    out = [r["doc_id"] for r in simhash.drop_near_duplicates(once).collect()]
    roots = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in once.collect()})
    assert sorted(out) == sorted(set(roots.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}


def test_runs_are_never_cut():
    import pyarrow as pa

    keys = np.repeat(np.arange(50), np.arange(50))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7])], names=["k"]) for i in range(0, len(keys), 7)]
    parts = [t["k"].to_numpy() for t in sorted_runs(batches, ["k"], 20)]
    assert (np.concatenate(parts) == keys).all() and all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))


def test_spanning_edges_join_the_same():
    a, b = spanning_edges(np.array([0, 1, 5]), np.array([1, 2, 6]), 8)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 0), (2, 0), (6, 5)]


def vectors(draw):
    out, i = [], 0
    for label in (1, 2, None):
        for _ in range(20):
            out.append((i, draw.normal(size=16).astype(np.float32).tolist(), label))
            i += 1
        centre = draw.normal(size=16)
        for _ in range(25):  # more near copies than a neighbour list holds
            out.append((i, (centre + draw.normal(size=16) * 0.02).astype(np.float32).tolist(), label))
            i += 1
    out += [(i + 1, out[0][1], 1), (i + 2, out[0][1], 1), (i + 3, out[0][1], 2)]  # copies, and one of another label
    out += [(i + 4, None, 1), (i + 5, [0.0] * 16, 1), (i + 6, [float("nan")] * 16, 1), (i + 7, [None] + [1.0] * 15, 1), (i + 8, [], 1), (i + 9, [1.0] * 8, 1), (None, [1.0] * 16, 1)]
    return out


def test_near_duplicate_vectors_against_brute_force(spark):
    rows = vectors(np.random.default_rng(5))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, node string, part int")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j in good if j != i and good[j][1] == good[i][1] and len(good[j][0]) == len(good[i][0]) and float(good[i][0] @ good[j][0]) >= 0.98] if i in good else [] for i, _, _ in rows}
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(out) == len(rows)
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        root = None if i is None else min(j for j in seen if j is not None)
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links[i]), root, i == root), i
    assert all(r["recall"] == 1.0 and r["links_tested"] > 0 for r in out.values())
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# --- the near duplicates of the pipeline ------------------------------------------------------------------------------


def brute_similarity(a, b):
    def shingles(text):
        words = text.lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edited_copies():
    """Texts of 40 to 1000 words, each with a copy of which some words are replaced; about the similarities 0.6 to 1."""
    draw = np.random.default_rng(11)
    pairs = []
    for n in range(240):
        words = [f"w{k}" for k in draw.integers(0, 5000, (40, 100, 300, 1000)[n % 4])]
        other = list(words)
        for at in draw.choice(len(words), max(1, int(len(words) * draw.uniform(0, 0.05))), replace=False):
            other[at] = f"x{at}"
        pairs.append((" ".join(words), " ".join(other)))
    return pairs


def test_edited_copies_are_dropped_from_similarity_0_8_on(spark):
    pairs = edited_copies()
    rows = [(2 * i + side, pair[side]) for i, pair in enumerate(pairs) for side in (0, 1)]
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [i for i, pair in enumerate(pairs) if brute_similarity(*pair) >= 0.8]
    far = [i for i, pair in enumerate(pairs) if brute_similarity(*pair) < 0.8]
    assert len(near) > 80 and len(far) > 20
    assert all({2 * i, 2 * i + 1} <= left for i in far) and all(2 * i in left for i in near)
    assert sum(2 * i + 1 not in left for i in near) >= 0.98 * len(near)


def test_near_duplicates_join_what_all_pairs_join(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = [[f"b{k}_{i}" for i in range(60)] for k in range(3)]
    texts = []
    for n in range(150):
        words = list(base[n % 3])
        for at in draw.integers(0, 60, n % 5):
            words[at] = f"e{draw.integers(0, 4)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 500)  # many units a key
    shingled = simhash._shingled
    monkeypatch.setattr(simhash, "_shingled", lambda *a: shingled(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))  # all meet
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = simhash.near_duplicates(df).collect()
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if brute_similarity(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    by_root = {}
    for r in found:
        by_root.setdefault(r["root"], set()).add(r["id"])
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(i for i in range(150) if root[i] == r) for r in set(root))


def test_wide_fingerprints_are_majorities_and_blocks_their_sixteen_bits():
    shingles = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 600, dtype=np.uint64))
    ones = [0] * 64
    for h in shingles.tolist():
        z = (h + int(simhash._PLUS[3])) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        z = int.from_bytes((z ^ z >> 31).to_bytes(8, "little"), "big")
        ones = [n + (z >> (63 - i) & 1) for i, n in enumerate(ones)]
    words = simhash.wide_fingerprint(shingles)
    assert len(words) == simhash.NEAR_WORDS and np.unpackbits(words[3:4].view(np.uint8)).tolist() == [int(2 * n > len(shingles)) for n in ones]
    keys = simhash.block_keys(words)
    assert len(keys) == len(set(keys)) == 80 and [k & 65535 for k in keys] == words.view(np.uint16).tolist()


@pytest.mark.parametrize("chunk", [4, 1024])
def test_candidates_share_a_block_of_their_fingerprints_and_are_close(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = np.random.default_rng(2)
    rows = []
    for family in range(4):
        centre = draw.integers(0, 1 << 64, 2, dtype=np.uint64)
        for n in range(30):
            words = centre.copy()
            for bit in draw.integers(0, 128, draw.integers(0, 20)):
                words[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append((30 * family + n, 10, *words.view(np.int64).tolist(), [family // 2, 10 + n % 3]))  # families meet in blocks
    close = lambda a, b: sum((x ^ y) % 2**64 >> i & 1 for x, y in zip(a[2:4], b[2:4]) for i in range(64)) <= simhash.NEAR_BITS
    expected = {i: i for i in range(120)}
    for a in rows:
        for b in rows[: a[0]]:
            if set(a[4]) & set(b[4]) and close(a, b) and expected[a[0]] != expected[b[0]]:
                old, new = max(expected[a[0]], expected[b[0]]), min(expected[a[0]], expected[b[0]])
                expected = {i: new if r == old else r for i, r in expected.items()}
    groups = simhash.close_groups(spark.createDataFrame(rows, "node bigint, n bigint, near0 bigint, near1 bigint, keys array<bigint>"))
    pairs = groups.join(groups.groupBy("key").agg(F.min("node").alias("least")), "key").select(F.col("least").alias("a"), F.col("node").alias("b"))
    roots = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert {i: roots.get(i, i) for i in range(120)} == expected and len(set(expected.values())) >= 4


def test_copies_that_meet_under_every_block_are_listed_once(spark):
    rows = [(n, 10, 1 << n % 5, 0, list(range(80))) for n in range(30)]
    groups = simhash.close_groups(spark.createDataFrame(rows, "node bigint, n bigint, near0 bigint, near1 bigint, keys array<bigint>"))
    assert sorted((r["node"], r["key"]) for r in groups.collect()) == [(n, 0) for n in range(30)]


def test_near_duplicates_leave_only_lists_of_rows_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestream.llm.common.shared_dir", lambda _: str(tmp_path))
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [1, 3]
    assert {c for p in tmp_path.iterdir() for c in spark.read.parquet(str(p)).columns} <= {"_ls_id", "_ls_md5", "stays", "rows"}


def test_rows_that_share_an_id_or_have_none_are_decided_one_by_one(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (7, text("a") + " end"), (7, text("clean")), (None, text("a") + " stop"), (9, text("p")), (9, text("q")), (None, text("z")), (None, text("z"))]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = [(1, text("a")), (7, text("clean")), (9, text("p")), (9, text("q")), (None, text("z"))]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, kept))


def brute_vectors(rows, threshold=0.98):
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([lab for _, _, lab in rows])
    close = (unit @ unit.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(close, root[None, :], len(rows)).min(axis=1))
        if (new == root).all():
            return close.sum(axis=1), root
        root = new


def clumps():
    """Two tight clumps whose lists are full of their own kind and that link across, groups of two and three, and others."""
    draw = np.random.default_rng(8)
    near = lambda c, spread: c + draw.normal(size=(1, 32)) * spread
    a = draw.normal(size=32)
    a /= np.linalg.norm(a)
    side = draw.normal(size=32)
    side -= side @ a * a
    side /= np.linalg.norm(side)
    b = 0.984 * a + np.sqrt(1 - 0.984**2) * side
    vectors = [near(c, 0.002)[0] for c in (a, b) for _ in range(90)]
    for k in range(120):
        c = draw.normal(size=32)
        vectors += [near(c, 0.02)[0] for _ in range(1 + k % 3)]
    order = draw.permutation(len(vectors))
    return [(int(i), vectors[j].tolist(), int(j >= 240)) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [32, 256])
def test_no_link_is_lost_between_crowded_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clumps()
    n, root = brute_vectors(rows)
    assert n.max() > 100
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (int(n[i]), int(root[i])) for i in range(len(rows))}
    assert {r["recall"] for r in out} == {1.0}


def test_a_label_that_misses_links_is_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "descend", lambda small, graph, count, threshold: graph.where("cos > 2"))  # finds nothing
    rows = clumps()
    n, root = brute_vectors(rows)
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    first = [r for r in out if rows[r["vec_id"]][2] == 0]
    assert all((r["n_links"], r["component_id"]) == (n[r["vec_id"]], root[r["vec_id"]]) for r in first) and {r["recall"] for r in out} == {1.0}


def test_recall_is_null_where_there_is_no_link_to_test(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(3)], "vec_id bigint, embedding array<double>, label int")
    assert {(r["recall"], r["links_tested"], r["n_links"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()} == {(None, 0, 0)}


def far_from_the_audit():
    """Pairs and triples of tight clumps of 11 to 30 that link across, none with an id divisible by 20, and single vectors."""
    draw = np.random.default_rng(21)
    clumped, single = [], []
    for k in range(18):
        a = draw.normal(size=64)
        a /= np.linalg.norm(a)
        centres = [a]
        for _ in range(1 + k % 3):
            side = draw.normal(size=64)
            side -= side @ centres[-1] * centres[-1]
            centres.append(0.986 * centres[-1] + np.sqrt(1 - 0.986**2) * side / np.linalg.norm(side))
        size = int(draw.integers(11, 31))
        clumped += [(c + draw.normal(size=64) * 0.001, k % 2) for c in centres for _ in range(size)]
    single = [(draw.normal(size=64), i % 2) for i in range(400)]
    ids = iter(i for i in range(10_000) if i % 20)
    other = iter(range(20_000, 40_000))
    rows = [(next(ids), v.tolist(), lab) for v, lab in clumped] + [(next(other), v.tolist(), lab) for v, lab in single]
    return [rows[i] for i in draw.permutation(len(rows))]


def test_no_link_is_lost_where_no_audited_id_lies(spark):
    rows = sorted(far_from_the_audit())
    n, root = brute_vectors(rows)
    assert (n >= 10).sum() > 500
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)).collect()
    expected = {rows[i][0]: (int(n[i]), rows[int(root[i])][0]) for i in range(len(rows))}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == expected
    assert {r["links_tested"] for r in out} == {0} and {r["recall"] for r in out} == {None}
