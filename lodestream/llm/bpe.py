"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a tree are the adjacent pairs of a word's symbols, each the pair's merge rank and place (or none); an inner
node holds the smaller of its children. The root is therefore the leftmost pair of the lowest rank. A merge changes three
leaves - its own, the swallowed one and the left neighbour - and the nodes above them, so each costs a logarithm of the
word's length, until the root says that no pair can be merged.

Words up to ``WIDE`` bytes are encoded many at a time, one column of a tree array for each word; longer ones (runs without
white space can be as long as a document) one at a time with the same tree in lists. Words seen before come from a bounded
cache. The vocabulary file is a parameter; nothing is trained or copied.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import parts, read_table, readable_text

WIDE = 64
CACHE_WORDS = 300_000
NONE = np.int64(1) << 60


def _class(starts: str) -> str:
    """A character class of all code points whose general category starts with the letter."""
    out, first = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp))[0] == starts
        if inside and first is None:
            first = cp
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return "".join(out)


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """How byte-level vocabularies of this kind cut a text into words (fixed: the vocabulary file presumes it)."""
    letter, number = _class("L"), _class("N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: A space that is not followed by a word: only texts without one can be cut at their spaces.
LOOSE_SPACE = re.compile(" (?=[\\s\\x1c-\\x1f]|\\Z)")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A vocabulary file with its merges. ``encode`` gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pair_rank = {}
        for rank, (a, b) in enumerate(merges):
            self.pair_rank.setdefault((vocab[a], vocab[b]), rank)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.merged_list = self.merged.tolist()
        keys = np.array([(a << 32) | b for a, b in self.pair_rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[np.array(list(self.pair_rank.values()), dtype=np.int64)[order], 0]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    # --- one tree for each of many short words -------------------------------------------------------------------

    def _values(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, leaves: int) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] * leaves + place, NONE)

    def _short(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of 2 to ``leaves`` bytes. Arrays are (place, word), held flat; the root is row 1 of ``tree``."""
        n = len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(n, leaves)
        ids = self.byte_id[raw.T].copy()
        place = np.arange(leaves)[:, None]
        tree = np.full((2 * leaves, n), NONE)
        pairs = self._values(ids[:-1], ids[1:], place[:-1], leaves)
        tree[leaves : 2 * leaves - 1] = np.where(place[1:] < length, pairs, NONE)
        level = leaves
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        after = np.broadcast_to(place + 1, (leaves, n)).copy()
        before = np.broadcast_to(place - 1, (leaves, n)).copy()
        alive = place < length
        tree, ids, after, before = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        alive = alive.reshape(-1)
        word = np.arange(n)
        while True:
            top = tree[n + word]
            word = word[top < NONE]
            if not len(word):
                break
            top = tree[n + word]
            rank, p = top // leaves, top % leaves
            here = p * n + word
            q = after[here]
            gone = q * n + word
            new = self.merged[rank]
            ids[here] = new
            alive[gone] = False
            r = after[gone]
            after[here] = r
            right = r < length[word]
            next_at = np.where(right, r, 0) * n + word
            before[next_at[right]] = p[right]
            o = before[here]
            left = o >= 0
            prev_at = np.where(left, o, 0) * n + word
            tree[(leaves + q) * n + word] = NONE
            tree[(leaves + p) * n + word] = np.where(right, self._values(new, ids[next_at], p, leaves), NONE)
            lw = word[left]
            tree[(leaves + o[left]) * n + lw] = self._values(ids[prev_at[left]], new[left], o[left], leaves)
            nodes = [leaves + p, leaves + q, np.where(left, leaves + o, leaves + p)]
            level = leaves
            while level > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[x * n + word] = np.minimum(tree[2 * x * n + word], tree[(2 * x + 1) * n + word])
                level >>= 1
        kept = alive.reshape(leaves, n).T
        flat = ids.reshape(leaves, n).T[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    # --- one tree for a long word --------------------------------------------------------------------------------

    def _long(self, word: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, rank_of = int(NONE), self.pair_rank.get

        def value(i: int, j: int) -> int:
            rank = rank_of((ids[i], ids[j]))
            return none if rank is None else rank * leaves + i

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = value(i, i + 1)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, v: int) -> None:
            i += leaves
            tree[i] = v
            while i > 1:
                i >>= 1
                x, y = tree[2 * i], tree[2 * i + 1]
                low = x if x < y else y
                if tree[i] == low:
                    break
                tree[i] = low

        while (top := tree[1]) < none:
            rank, p = divmod(top, leaves)
            q = after[p]
            ids[p], ids[q] = self.merged_list[rank], -1
            r = after[q]
            after[p] = r
            put(q, none)
            if r < n:
                before[r] = p
                put(p, value(p, r))
            else:
                put(p, none)
            if (o := before[p]) >= 0:
                put(o, value(o, p))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of words into the cache, all short ones of a width at once."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            if len(b) == 1:
                self.words[w] = self.byte_id[b[0]].astype("<u4").tobytes()
            elif len(b) > WIDE:
                self.words[w] = self._long(b)
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append((w, b))
        for width, found in by_width.items():
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                self.words.update(zip((w for w, _ in part), self._short([b for _, b in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        find = word_pattern().findall
        docs: list[list[tuple[str, list[str] | int]]] = []  # ("words" | "pieces", strings) or ("id", a special token)
        for text in texts:
            doc: list[tuple[str, list[str] | int]] = []
            for i, segment in enumerate(self.split_special.split(text) if self.split_special else [text]):
                if i % 2:
                    doc.append(("id", self.special[segment]))
                elif LOOSE_SPACE.search(segment):
                    doc.append(("words", find(segment)))
                else:
                    first, *rest = segment.split(" ")
                    doc.append(("words", find(first)))
                    doc.append(("pieces", rest))  # each with the space that was before it
            docs.append(doc)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        seen: dict[str, set[str]] = {"words": set(), "pieces": set()}
        for kind, strings in chain.from_iterable(docs):
            if kind != "id":
                seen[kind].update(strings)
        new = {p: find(" " + p) for p in seen["pieces"].difference(self.pieces)}
        self._learn(seen["words"].union(chain.from_iterable(new.values())).difference(self.words))
        self.pieces.update((p, b"".join(map(self.words.__getitem__, found))) for p, found in new.items())
        known = {"words": self.words.__getitem__, "pieces": self.pieces.__getitem__}
        return [b"".join(x.to_bytes(4, "little") if kind == "id" else b"".join(map(known[kind], x)) for kind, x in doc) for doc in docs]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; ids beyond the vocabulary stand for nothing, broken UTF-8 for U+FFFD."""
        ids = np.frombuffer(packed, dtype="<u4")
        if len(ids) and ids.max() >= len(self.bytes_of):
            ids = ids[ids < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, token_ids (packed little-endian unsigned 32-bit, as training shards hold them),
    and with ``decode`` the text that those ids stand for, ``decoded``.

    Null text counts as empty and has no tokens; ids may be null or repeat; other columns are not read; an empty table
    gives an empty result. ``vocabulary`` must be readable at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), readable_text(text_col).alias("_ls_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for part in parts(batches, 1, 512, 4_000_000):
            packed = tool.encode(part.column(1).to_pylist())
            columns = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
            names = ["_ls_id", "n_tokens", "token_ids"]
            if decode:
                columns.append(pa.array(map(tool.decode, packed), pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"_ls_id {kind}, n_tokens bigint, token_ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("_ls_id", id_col)


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) from packed ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("_ls_packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((tool.decode(x.as_py()) for x in batch.column(1)), pa.string())], names=["_ls_id", "text"])

    return rows.mapInArrow(run, f"_ls_id {rows.schema[0].dataType.simpleString()}, text string").withColumnRenamed("_ls_id", id_col)


def token_digests(df: DataFrame, encode: Callable[..., DataFrame] = bpe_encode) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 digests of the ids and of the decoded text."""
    out = encode(df, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
