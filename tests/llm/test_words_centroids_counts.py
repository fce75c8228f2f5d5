"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import centroids, spelling, token_counts
from lodestream.llm.queries import OP12_SQL, QUERIES

UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return found


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, ratio=10):
    out = {}
    for w, n in count.items():
        near = [v for v in count if one_edit(w, v)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= ratio * n and count[best] > 0 else None
        out[w] = [form, n, len(near), count[form] if form is not None else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return out


def found_variants(df):
    return {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in df.collect()}


def test_corpus_words(awkward, empty):
    expected = brute_words((r["doc_id"], r["text"]) for r in awkward.collect())
    got = spelling.corpus_words(awkward).collect()
    assert len(got) == len(expected) and {r["word"]: r["n"] for r in got} == expected
    assert spelling.corpus_words(empty).count() == 0


def test_slips_and_latin_letters(spark):
    draw = random.Random(3)
    words = ["Straßenbahn", "ÉCOLIERES", "naïvement", "Überraschung", "spelling", "aaaaaaaa", "x×÷øÿÀzzz"]
    rows = [(i, " ".join(draw.choice(words) + draw.choice(["", ",", "-", "7"]) for _ in range(60))) for i in range(80)]
    got = spelling.corpus_words(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = brute_words(rows)
    assert {r["word"]: r["n"] for r in got.collect()} == expected and len(expected) > len(words)


def test_variants_against_brute_force(spark):
    draw = random.Random(11)
    count = {}
    for _ in range(60):
        base = "".join(draw.choice("abcdeéstuvÿ") for _ in range(draw.randint(7, 11)))
        count[base] = draw.choice([1000, 5000])
        for _ in range(8):  # one or two edits away, so that chains of forms arise
            word = base
            for _ in range(draw.randint(1, 2)):
                at = draw.randrange(len(word))
                word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("abzÿ") + word[at:], word[:at] + draw.choice("abzÿ") + word[at + 1 :]])
            count.setdefault(word, draw.choice([1, 2, 20, 100, 100]))
    rows = [(w, n - n // 3, "x") for w, n in count.items()] + [(w, n // 3, "y") for w, n in count.items()] + [(None, 5, "z")]
    got = found_variants(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n bigint, root string").repartition(5)))
    assert got == brute_variants(count)
    assert any(f[0] and f[0] != f[4] for f in got.values())  # a chain of more than one form


def test_every_edit_of_short_and_long_words_is_found(spark):
    words = {"", "a", "b", "ab", "ba", "abc", "abcd", "aabb", "bbaa", "hello", "helo", "hell", "ahello", "hellp", "x" * 300, "x" * 299, "x" * 299 + "y"}
    got = found_variants(spelling.spelling_variants(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")))
    assert got == brute_variants(dict.fromkeys(words, 1))


def test_variants_of_an_empty_table_null_counts_and_bad_ratio(spark):
    kind = "word string, n bigint"
    assert spelling.spelling_variants(spark.createDataFrame([], kind)).count() == 0
    got = spelling.spelling_variants(spark.createDataFrame([("variant", None), ("variants", 0)], kind)).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"]) for r in got} == {("variant", None, "variant", 0, 1), ("variants", None, "variants", 0, 1)}
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], kind), ratio=1)


def brute_centroids(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    placed = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in placed:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, d, j in placed), key=repr)


def found_centroids(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def vectors(seed, n=600):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(9, 64))
    out = [(i, (middle[i % 9] + draw.normal(size=64) * draw.choice([0.01, 0.3, 1.0])).tolist()) for i in range(n)]
    out += [(n + i, [round(x) / 64 for x in draw.integers(-1, 2, size=64).tolist()]) for i in range(150)]  # many ties
    out += [(2 * n + i, out[0][1]) for i in range(200)] + [(7, out[5][1]), (7, out[5][1]), (None, out[3][1]), (None, out[4][1])]  # copies, repeated and null ids
    out += [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [1.0] * 63 + [None]), (9004, [1.0] * 63 + [float("nan")]), (9005, [float("-inf")] + [0.0] * 63)]
    return out


SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, x string"


@pytest.mark.parametrize("seed", [1, 2])
def test_centroids_against_full_comparison(spark, seed):
    df = spark.createDataFrame([(i, v, None, "c", "x") for i, v in vectors(seed)], SCHEMA).repartition(4)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found_centroids(centroids.centroid_clusters(df)) == brute_centroids(rows)
    assert found_centroids(centroids.centroid_clusters(df, rounds=7)) == brute_centroids(rows, rounds=7)


def test_few_and_no_vectors(spark):
    rows = vectors(3)
    few = spark.createDataFrame([(i, v, 1, None, None) for i, v in rows[:5]], SCHEMA)
    assert found_centroids(centroids.centroid_clusters(few)) == brute_centroids([(r["vec_id"], r["embedding"]) for r in few.collect()])
    none = centroids.centroid_clusters(spark.createDataFrame([(9000, None, 1, None, None)], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_comparisons_and_stay_right():
    draw = np.random.default_rng(5)
    x = (draw.normal(size=(20, 64))[draw.integers(0, 20, 3000)] * 60 + draw.normal(size=(3000, 64)) * 4).astype(np.int64)
    c = x[:16].copy()
    state = centroids.scanned(x, c, 4)
    rescanned = 0
    for step in range(12):
        new = c + draw.integers(-2, 3, size=c.shape)
        moved = centroids._up(np.sqrt(((new - c) ** 2).sum(axis=1)))
        used = centroids.reassigned(x, new, moved, 4 if step < 6 else 2, state)
        c = new
        exact = centroids.squared(x, c)
        assert (state["cluster"] == exact.argmin(axis=1)).all()
        root = np.sqrt(exact)
        assert (state["lower"] <= np.take_along_axis(root, state["near"], axis=1)).all() and (state["upper"] >= np.take_along_axis(root, state["cluster"][:, None], axis=1)[:, 0]).all()
        others = root.copy()
        np.put_along_axis(others, np.c_[state["cluster"], state["near"]], np.inf, axis=1)
        assert (state["rest"] <= others.min(axis=1)).all()
        rescanned += (used >= state["near"].shape[1]).sum()
    assert rescanned < 0.5 * 12 * len(x)


def test_large_components_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 5]], dtype=np.int64)
    assert centroids.squared(x, x[::-1]).tolist() == [[((1 << 27) - 3) ** 2 + ((1 << 27) + 5) ** 2, 0], [0, ((1 << 27) - 3) ** 2 + ((1 << 27) + 5) ** 2]]


def test_op12_equals_its_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(i, v, 1) for i, v in vectors(4, 300)], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"create or replace temp view embeddings as from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert found_centroids(QUERIES["op12_centroids"](spark, str(tmp_path))) == sorted(duckdb.sql(f"select {names} from ({OP12_SQL})").fetchall(), key=repr)


def library_counts(rows):
    import public_tokenizers
    import tokenizers

    tool = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted(((i, len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


def counted(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in df.collect()), key=repr)


def test_token_counts_equal_the_library(awkward, empty):
    out = token_counts.token_counts(awkward)
    assert counted(out) == library_counts((r["doc_id"], r["text"]) for r in awkward.collect())
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out.collect()) and any(r["over_limit"] for r in out.collect())
    assert token_counts.token_counts(empty).count() == 0


def test_parts_of_long_texts_change_nothing():
    import public_tokenizers
    import tokenizers

    tool = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(2)
    bits = ["word", " ", "  ", "\n", " \n ", "\t", "it's", "日本語", "<|endoftext|>", "12 3", "\u00a0", "\x1c", " '", "e\u0301", "🎉", "..."]
    for _ in range(200):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 60)))
        parts = list(token_counts._parts(text, 5))
        assert "".join(parts) == text
        assert sum(len(tool.encode(p, add_special_tokens=False)) for p in parts) == len(tool.encode(text, add_special_tokens=False))


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    asked = []

    def watched(texts, path, real=token_counts.encoded):
        asked.extend(bytes(r["digest"]) for r in texts.collect())
        return real(texts, path)

    monkeypatch.setattr(token_counts, "encoded", watched)
    cache = str(tmp_path / "cache")
    first = [(i, f"text number {i % 40}") for i in range(60)] + [(None, None), (99, "")]
    second = first + [(200, "new"), (201, "new"), (202, "another"), (203, "text number 1")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert counted(token_counts.token_counts(frame(first), cache)) == library_counts(first)
    assert len(asked) == len(set(asked)) == 41
    asked.clear()
    assert counted(token_counts.token_counts(frame(second), cache)) == library_counts(second)
    assert sorted(asked) == sorted(hashlib.sha256(t).digest() for t in (b"new", b"another"))
    asked.clear()
    assert counted(token_counts.token_counts(frame(second), cache)) == library_counts(second) and not asked


def test_another_tokenizer_has_counts_of_its_own(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    rows = [(1, "A few plain words, and naïve ones."), (2, None), (3, "<s> in a text </s>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    token_counts.token_counts(df, cache)
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, cache, tokenizer=path).collect()}
    assert got == {i: len(tool.encode(t or "")) for i, t in rows}
    assert token_counts.tokenizer_version(path) != token_counts.tokenizer_version(public_tokenizers.path("byte_bpe_50k.json"))


def test_queries_on_a_small_folder(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    words = Counter({w: n for w, n in brute_words((r["doc_id"], r["text"]) for r in awkward.collect()).items() if n >= 2})
    out = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert found_variants(out) == brute_variants(words)
    out = QUERIES["op13_token_counts"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert counted(out) == library_counts((r["doc_id"], r["text"]) for r in awkward.collect())
