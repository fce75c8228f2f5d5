import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestream.llm import bpe, mixing, sharding
from lodestream.llm.common import settle

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_of_any_text(texts):
    tool = bpe.encoder(PATH)
    for text, packed in zip(texts, tool.encode(texts)):
        assert ids(packed) == REFERENCE.encode(text, add_special_tokens=False).ids
        assert tool.decode(packed) == REFERENCE.decode(ids(packed), skip_special_tokens=False) == text


def test_bpe_of_white_space_marks_and_long_words():
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab '\n\t  .12é日sxt<|>") for _ in range(60)) for _ in range(400)]
    texts += ["a<|endoftext|>b <|endoftext|>", "it's WE'LL", "x" * 3000, "ab" * 100 + " " + "ü" * 65, "\x1c \x85 ​ ", " " * 50 + "x"]
    tool = bpe.Encoder(PATH)
    assert [ids(p) for p in tool.encode(texts)] == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def test_both_trees_agree(monkeypatch):
    words = ["".join(random.Random(i).choice("abcdeé ") for _ in range(2 + i % 60)).strip() + "zq" for i in range(300)]
    wide = bpe.Encoder(PATH).encode(words)
    monkeypatch.setattr(bpe, "WIDE", 1)
    assert bpe.Encoder(PATH).encode(words) == wide


def test_bpe_over_tables(awkward, empty):
    out = bpe.bpe_encode(awkward, decode=True).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in awkward.collect())
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in out) == texts
    assert all(r["n_tokens"] == len(REFERENCE.encode(r["decoded"], add_special_tokens=False).ids) for r in out)
    back = bpe.bpe_decode(bpe.bpe_encode(awkward)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == texts
    assert bpe.bpe_encode(empty).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------


def water_filled(sizes, share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    open_ = set(names)
    while open_:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > most * sizes[n]}
        if not over:
            return target | {n: left * weight[n] / total for n in open_}
        for n in over:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in over)
        open_ -= over
    return target


def test_mix_meets_targets(awkward, empty):
    out = mixing.mix(awkward.where("doc_id is not null")).collect()
    source = {r["doc_id"]: r["source"] for r in awkward.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        targets[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = water_filled(sizes)
    assert all(abs(targets[s] - expected[s]) < 1e-6 and abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    again = mixing.mix(awkward.where("doc_id is not null").repartition(2)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert mixing.mix(empty).count() == 0 and mixing.mix(awkward).count() == awkward.count()


def test_prefix_sums_over_many_ranges_equal_those_over_one(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"))
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == one
    db = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    assert sorted(db.execute(mixing.OP8_SQL).fetchall()) == one


def test_mixed_documents_repeat_whole_rows(awkward):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r["doc_id"]] += 1
    assert copies and max(n for i, n in copies.items() if i not in (200, None)) <= 2
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(awkward).collect() if r["size"] and r["doc_id"] not in (200, None)}
    assert {i: n for i, n in copies.items() if i not in (200, None)} == {i: n for i, n in taken.items() if n}


# --- sharding ---------------------------------------------------------------------------------------------------------


def brute_shards(groups, shards):
    """Sizes of the shards with the smallest capacity: heavy groups first, those above the capacity alone."""
    heavy = sorted(groups, key=lambda g: (-g[1], g[0]))[:shards]
    sums = [x for _, x in heavy] + [x for g in sorted(groups) if g not in set(heavy) for x in [g[1]]]
    for capacity in range(sum(sums) + 1):
        found = [0]
        for x in sums:
            if found[-1] and found[-1] + x > capacity:
                found.append(0)
            found[-1] += x
        if len(found) <= shards:
            return capacity, found


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_minimax_over_more_groups_than_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "RANGE_BITS", 4)
    monkeypatch.setattr(sharding, "FINER_BITS", 2)
    draw = random.Random(seed)
    sizes = [draw.randint(1, 60) if draw.random() < 0.97 else draw.randint(100, 900) for _ in range(800)]
    if seed % 2:
        sizes[5] = 30_000  # more than a shard
    groups = [(h, x) for h, x in zip(draw.sample(range(1 << 60), 800), sizes)]
    of_heavy, begins = sharding.minimax_cuts(spark.createDataFrame(groups, "h bigint, bytes bigint"), 8)
    found = defaultdict(int)
    for h, x in groups:
        found[of_heavy.get(h, next((s for first, s in reversed(begins) if h >= first), 0))] += x
    capacity, _ = brute_shards(groups, 8)
    alone = [x for _, x in groups if x > capacity]
    assert sorted(found) == list(range(8)) and sorted(found.values())[8 - len(alone) :] == sorted(alone)
    assert max(sorted(found.values())[: 8 - len(alone)]) == capacity


def test_shards_keep_equal_texts_together_and_slots_gapless(spark, awkward, empty):
    out = sharding.shard_documents(awkward, 5).collect()
    assert len(out) == awkward.count()
    slots, by_text = defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for r in awkward.collect():
        texts[r["doc_id"]].add((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16))
    for r in out:
        slots[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"]].add(r["shard"])
        assert (r["text_crc32"], r["size"]) in texts[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_documents(empty, 5).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    placed = sharding.shard_documents(hot, 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("k")).collect()
    assert all(r["n"] == r["m"] + 1 == r["k"] for r in placed)


def test_a_hot_text_leaves_the_other_shards_even_and_few_groups_leave_some_empty(spark):
    sizes = [10] * 2000
    sizes[700], sizes[900] = 10_000, 800
    groups = [(i << 48, x) for i, x in enumerate(sizes)]
    frame = spark.createDataFrame(groups, "h bigint, bytes bigint")
    of_heavy, begins = sharding.minimax_cuts(frame, 40)
    found = defaultdict(int)
    for h, x in groups:
        found[of_heavy.get(h, next((s for first, s in reversed(begins) if h >= first), 0))] += x
    assert sorted(found) == list(range(40)) and sorted(found.values())[-2:] == [800, 10_000]
    assert max(sorted(found.values())[:-2]) <= 530 and min(found.values()) >= 250
    assert sharding.minimax_cuts(frame.limit(0), 40) == ({}, [])
    assert sorted(sharding.minimax_cuts(frame.limit(3), 40)[0].values()) == [0, 1, 2]


def test_rows_of_one_id_and_text_are_spread_over_chunks(spark):
    hot = spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.shard_documents(hot, 4).collect()
    assert len({r["shard"] for r in found}) == 1 and sorted(r["slot"] for r in found) == list(range(5000))


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages_follow_each_other(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settle(stage(spark, docs, sf_dir))
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()}
            assert all(labels.get(i, 1) == 1 for i in gone)
        seen.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] and seen[4] == seen[5] > 0
