"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds (multiplies) the
vectors of its letters, permuted (rolled) by their place; a document's vector bundles (sums) those of its trigrams. A
language's prototype bundles all its learnable documents; a document gets the language of the largest cosine.

Learning is a sum of integers over all documents: each task adds up its own, then the components are summed by language
with partial aggregation, so nothing is sampled and the order of the rows does not matter.

Texts are read in pieces of ``PIECE`` letters and trigrams get their vectors ``PART`` at a time, so memory is bounded however
long a text is and however many different trigrams it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import held_out, parts, read_table, readable_text

DIMENSIONS = 512
SEED = 42
#: Characters of a text that are looked at together, and trigrams whose vectors are held together.
PIECE, PART = 100_000, 4096
#: Letters whose vectors a task holds, 512 bytes each; those of a part (at most 3 * ``PART``) always fit.
LETTERS = 50_000
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Letters:
    """Random vectors of code points; 0 stands for whatever is between words. At most ``LETTERS`` are held."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place = np.full(0x110000, -1, dtype=np.int32)
        self.table, self.used = np.empty((256, DIMENSIONS), dtype=np.int8), 0

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The vectors of distinct code points."""
        if self.used + len(points) > LETTERS and (self.place[points] < 0).any():
            self.clear()
        for p in points[self.place[points] < 0].tolist():
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used] = np.random.default_rng([SEED, p]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
            self.place[p] = self.used
            self.used += 1
        return self.table[self.place[points]]


def trigrams(texts: list[str], inner: list[tuple[bool, bool]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over some texts: (text, trigram, count) by text, and the trigrams' code points, one row each.

    Letters are lower case, everything else is one 0 between words; no trigram spans two words. ``inner`` says of each
    text whether its first and its last letter only stand beside it: they are parts of trigrams, but no middles.
    """
    lowered = [t.lower() for t in texts] if inner is None else texts
    points = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.array([len(t) + 1 for t in lowered])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)[: len(points)]
    own = np.ones(len(points), dtype=bool)
    if inner is not None and len(points):
        last = np.cumsum(length) - 2
        first = last - length + 2
        beside = np.array(inner, dtype=bool).reshape(-1, 2)
        own[first[beside[:, 0]]] = False
        own[last[beside[:, 1]]] = False
    points = np.where(letter_table()[points], points, 0)
    points, owner, own = np.r_[np.uint32(0), points, np.uint32(0)], np.r_[owner[:1], owner, owner[-1:]], np.r_[False, own, False]
    keep = np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]
    points, owner, own = points[keep], owner[keep], own[keep]
    alphabet, code = np.unique(points, return_inverse=True)
    middle = np.flatnonzero((points[1:-1] != 0) & own[1:-1]) + 1
    size = len(alphabet)
    gram = (code[middle - 1].astype(np.int64) * size + code[middle]) * size + code[middle + 1]
    grams, gram = np.unique(gram, return_inverse=True)
    pair, count = np.unique(owner[middle] * np.int64(max(1, len(grams))) + gram, return_counts=True)
    letters = np.stack([alphabet[grams // (size * size)], alphabet[grams // size % size], alphabet[grams % size]], axis=1) if len(grams) else np.zeros((0, 3), dtype=np.uint32)
    return pair // max(1, len(grams)), pair % max(1, len(grams)), count, letters


def bound(letters: np.ndarray, draw: Letters) -> np.ndarray:
    """The vectors of trigrams: letters' vectors rolled by 2, 1 and 0 places, multiplied."""
    used, code = np.unique(letters, return_inverse=True)
    base = draw(used)
    a, b, c = code.reshape(letters.shape).T
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def pieces(texts: list[str]) -> Iterator[tuple[int, str, tuple[bool, bool]]]:
    """(text, lower-case piece, whether its first and last letter only stand beside it), ``PIECE`` characters at a time."""
    for i, text in enumerate(texts):
        low = text.lower()
        for a in range(0, len(low), PIECE):
            b = min(len(low), a + PIECE)
            yield i, low[max(0, a - 1) : b + 1], (a > 0, b < len(low))


def gathered(found: Iterator[tuple[int, str, tuple[bool, bool]]]) -> Iterator[list[tuple[int, str, tuple[bool, bool]]]]:
    """Pieces in lists of about ``PIECE`` characters."""
    held, size = [], 0
    for one in found:
        if held and size + len(one[1]) > 2 * PIECE:
            yield held
            held, size = [], 0
        held.append(one)
        size += len(one[1])
    if held:
        yield held


def bundled(texts: list[str], group: list[int], groups: int, draw: Letters) -> np.ndarray:
    """The sum of the trigrams' vectors of each group of texts: whole numbers, one row a group."""
    sums = np.zeros((groups, DIMENSIONS))
    for some in gathered(pieces(texts)):
        owner, gram, count, letters = trigrams([p for _, p, _ in some], [x for _, _, x in some])
        row = np.array([group[i] for i, _, _ in some])[owner]
        order = np.argsort(gram, kind="stable")
        row, gram, count = row[order], gram[order], count[order]
        for at in range(0, len(letters), PART):
            a, b = np.searchsorted(gram, [at, at + PART])
            used, place = np.unique(row[a:b], return_inverse=True)
            vectors = bound(letters[at : at + PART], draw).astype(np.float32)
            # As many rows of counts at once as one part has room for; sums of whole numbers below 2^24 are exact.
            for first in range(0, len(used), 256):
                mine = (place >= first) & (place < first + 256)
                table = np.zeros((min(256, len(used) - first), len(vectors)), dtype=np.float32)
                np.add.at(table, (place[mine] - first, gram[a:b][mine] - at), count[a:b][mine])
                sums[used[first : first + 256]] += table @ vectors
    return sums


def profiles(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """The prototype of each language: the sum of the vectors of all its documents. Null languages are left out."""
    rows = df.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), readable_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, sums = Letters(), {}
        for batch in parts(batches, 1):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            for x, v in zip(names, bundled(batch.column(1).to_pylist(), [place[x] for x in langs], len(names), draw)):
                sums[x] = sums.get(x, 0) + v
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([v.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["lang", "v"])

    by_place = rows.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in by_place.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    return found


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (the cosine, at least 0).

    ``und`` with score 0 if the text is null or has no letter, or if there is no prototype. Ties go to the first
    language by name. Very long texts are read whole, in pieces. Ids may be null or repeat, other columns are not read, an
    empty table gives an empty result.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in names]).reshape(-1, DIMENSIONS)
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), readable_text(text_col).alias("_ls_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Letters()
        for batch in parts(batches, 1):
            n = batch.num_rows
            sums = bundled(batch.column(1).to_pylist(), list(range(n)), n, draw)
            size = np.linalg.norm(sums, axis=1)
            best, score = np.full(n, -1), np.zeros(n)
            if names:
                cosine = sums @ matrix.T / np.where(size > 0, size, 1.0)[:, None]
                best = np.where(size > 0, cosine.argmax(axis=1), -1)
                score = np.where(size > 0, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
            labels = pa.array([names[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(score)], names=["_ls_id", "lang_pred", "score"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"_ls_id {kind}, lang_pred string, score double").withColumnRenamed("_ls_id", id_col)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    prototypes = profiles(docs.where(~held_out()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
