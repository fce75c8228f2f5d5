"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are the words of a bounded sample of labelled rows, all of them, as with any fitted vectoriser; their document
frequencies are counted over all documents. A term weighs (1 + log tf) x idf, and the neighbours of a text are the entries of
the largest cosine under these weights and no others. Examples with equal vectors are one entry of the index with the votes
of all.

Entries lie in blocks; each term keeps the largest weight it has in each block, so the sum over a query's terms bounds
every cosine in the block (terms of more than 1 in ``COMMON`` entries are summed up beforehand, as rows of a matrix), and blocks that cannot reach the k-th best are never opened: the neighbours are exact.

Neighbours vote by their distance. A text shares most of its rare words with an example by chance, and those say nothing
about its label, so the distance of a vote is the one minus the cosine of the same two vectors with every term scaled by its
relevance, which grows with how surely the share of examples that hold the term differs between the classes. Votes are
weighted by class too, so that they reflect the labelled rows and not the sample. Votes for the examples themselves, without
their own and under a relevance learned from other examples, calibrate them (pooled adjacent violators). Entries and their TF-IDF cosines are returned as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import held_out, labelled_sample, one_label, parts, read_table, readable_text, slices

#: Bounds the labelled rows of either class that are learned from.
PER_CLASS = 2000
NEIGHBOURS = 300
BLOCK = 32
#: A vote weighs (distance + SOFT) ** -SHARP, relative to the largest; PRIOR such votes go to the share of label 1.
SOFT, SHARP, PRIOR = 0.1, 12, 0.3
#: Examples are calibrated with a relevance that was learned from the other folds.
FOLDS = 5
#: Standard errors of a class difference at which a term has about half of its full relevance.
SURE = 3.0
FIRST_BLOCKS = 6
COMMON = 16
#: Texts whose common terms are multiplied with the matrix at once.
TOGETHER = 128
#: Decimals of a share of votes that count, and how near to the middle between two of them, in units of the last, it is
#: computed anew: sums of many texts at once are rounded otherwise than those of one text, by some 1e-15.
DECIMALS, NEAR = 9, 1e-3
words_of = re.compile(r"[^\W_]+").findall

Example = tuple[int, str, int]


class Terms:
    """Places of the terms, and their counts in a text."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's terms, ascending, and how often each occurs."""
        count: Counter[str] = Counter()
        for part in slices(text):
            count.update(words_of(part.lower()))
        at = np.fromiter(map(self.place.get, count, repeat(-1)), np.int64, len(count))
        n = np.fromiter(count.values(), np.int64, len(count))
        order = np.argsort(at)
        order = order[np.count_nonzero(at < 0) :]
        return at[order], n[order]


def vocabulary(examples: list[Example]) -> list[str]:
    """Every word of the examples, by name."""
    return sorted({w for _, text, _ in examples for w in words_of(text.lower())})


def document_frequencies(df: DataFrame, text_col: str, terms: list[str]) -> tuple[int, np.ndarray]:
    """Rows of the whole table, and for each term the rows that hold it: counted in each task, then summed."""
    names = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(names)}
        found, rows = np.zeros(len(names) + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                words: set[str] = set()
                for part in slices(text.as_py()):
                    words.update(words_of(part.lower()))
                # Words that are no terms are counted in the last place, which is overwritten.
                found[np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))] += 1
            rows += batch.num_rows
        found[-1] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    counted = df.select(readable_text(text_col).alias("t")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(terms) + 1, dtype=np.int64)
    found[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return int(found[-1]), found[:-1]


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those of start[1], and so on."""
    end = np.cumsum(length)
    out = np.repeat(start - end + length, length)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Entries (sparse unit vectors) in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.size = len(vectors)
        entry = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        common = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON > self.size)
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.size))
        often = self.row[term] >= 0
        self.matrix[self.row[term[often]], entry[often]] = weight[often]
        self.by_entry = self.matrix.T.copy()
        entry, term, weight = entry[~often], term[~often], weight[~often]
        order = np.lexsort((entry, term))
        self.entry, self.weight, term = entry[order], weight[order], term[order]
        # One run for each (term, block): where its postings start, and their largest weight.
        new = np.r_[True, (term[1:] != term[:-1]) | (self.entry[1:] // BLOCK != self.entry[:-1] // BLOCK)] if len(term) else np.zeros(0, dtype=bool)
        self.run_start = np.r_[np.flatnonzero(new), len(term)]
        self.run_block = self.entry[self.run_start[:-1]] // BLOCK
        self.run_max = np.maximum.reduceat(self.weight, self.run_start[:-1]) if len(term) else np.zeros(0)
        self.term_runs = np.searchsorted(term[self.run_start[:-1]], np.arange(terms + 1))
        self.term_start = self.run_start[self.term_runs]
        self.blocks = -(-self.size // BLOCK)

    def known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each vector: products of its weights and those of every entry, summed up over the common terms."""
        out = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row.take(terms)
            often = row >= 0
            out[i, row[often]] = weights[often]
        return out @ self.matrix

    def sums(self, terms: np.ndarray, weights: np.ndarray, entries: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Products of these weights and those of some entries, summed up over the terms; ``known`` is their row of ``known``."""
        row = self.row.take(terms)
        often = row >= 0
        few = terms[~often]
        first = self.term_start.take(few)
        length = self.term_start.take(few + 1) - first
        at = _spans(first, length)
        part = np.repeat(weights[~often], length)
        part *= self.weight.take(at)
        rare = np.bincount(self.entry.take(at), part, self.size)
        if known is not None:
            return rare[entries] + known[entries]
        all_ = np.zeros(len(self.matrix))
        all_[row[often]] = weights[often]
        return rare[entries] + self.by_entry.take(entries, axis=0) @ all_

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest cosine (ties: smallest entry), cosine above 0, and those cosines; ``known`` is the
        vector's row of ``known``."""
        if not self.size:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        row = self.row.take(terms)
        if known is None:
            known = weights[row >= 0] @ self.matrix.take(row[row >= 0], axis=0)
        terms, weights = terms[row < 0], weights[row < 0]
        first = self.term_runs[terms]
        length = self.term_runs[terms + 1] - first
        run, q = _spans(first, length), np.repeat(weights, length)
        block = self.run_block[run]
        bound = np.bincount(block, q * self.run_max[run], self.blocks) + np.maximum.reduceat(known, np.arange(0, self.size, BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosine, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
        now = np.zeros(self.blocks, dtype=bool)
        # A few blocks with the largest bounds set the bar; then all those are opened that can still reach it.
        some = FIRST_BLOCKS + k // BLOCK
        for reach in (order[:some], order[some:]):
            reach = reach[bound[reach] >= least - 1e-12]
            if not len(reach):
                break
            now[:] = False
            now[reach] = True
            here = now.take(block)
            if 2 * np.count_nonzero(here) > len(here):
                # Most runs are open: the postings of a term are read in one piece, and the other blocks are zeroed below.
                start, times = self.term_start.take(terms), weights
                size = self.term_start.take(terms + 1) - start
            else:
                mine, times = run.compress(here), q.compress(here)
                start = self.run_start.take(mine)
                size = self.run_start.take(mine + 1) - start
            at = _spans(start, size)
            part = self.weight.take(at)
            part *= np.repeat(times, size)
            score = (np.bincount(self.entry.take(at), part, self.size) + known) * np.repeat(now, BLOCK)[: self.size]
            if without >= 0:
                score[without] = 0.0
            more = np.flatnonzero(score > max(0.0, least - 1e-12))
            best, cosine = np.concatenate([best, more]), np.concatenate([cosine, score[more]])
            rounded = cosine.round(12)
            if len(best) > k:
                most = np.flatnonzero(rounded >= np.partition(rounded, -k)[-k])
                best, cosine, rounded = best[most], cosine[most], rounded[most]
            first_k = np.lexsort((best, -rounded))[:k]
            best, cosine = best[first_k], cosine[first_k]
            least = cosine[-1] if len(best) == k else 0.0
        return best, np.minimum(cosine, 1.0)


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the rising step function nearest to (x, y) with weights w (pooled adjacent violators), at their mean x."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # value, weight, mean x, last x
    for i in order:
        stack.append([y[i], w[i], x[i], x[i]])
        while len(stack) > 1 and (stack[-2][0] >= stack[-1][0] or stack[-2][3] == stack[-1][2]):
            v, u, mean, last = stack.pop()
            top = stack[-1]
            both = top[1] + u
            top[:] = [(top[0] * top[1] + v * u) / both, both, (top[2] * top[1] + mean * u) / both, last]
    return np.array([s[2] for s in stack]), np.array([s[0] for s in stack])


class Model:
    """Learned from examples (id, text, label), document frequencies over the corpus, and the labelled rows of each class."""

    def __init__(self, examples: list[Example], terms: list[str], rows: int, frequency: np.ndarray, labelled: tuple[int, int]):
        self.terms = Terms(terms)
        self.weight = np.log((1 + rows) / (1 + frequency)) + 1.0 if terms else np.zeros(0)
        sampled = [max(1, sum(y == c for _, _, y in examples)) for c in (0, 1)]
        self.class_weight = np.array([n / s for n, s in zip(labelled, sampled)])
        self.prior = (labelled[1] + 0.5) / (sum(labelled) + 1) if sum(labelled) else 0.5
        merged: dict[bytes, list] = {}
        for i, text, label in examples:
            vector = self.vector(text)
            entry = merged.setdefault(vector[0].tobytes() + vector[1].round(12).tobytes(), [vector, [0, 0], i])
            entry[1][label] += 1
        none = merged.pop(b"", [None, [0, 0], None])[1]
        # Entries that share their heaviest terms lie together, which makes the blocks' bounds tight.
        heaviest = lambda v: v[0][np.lexsort((v[0], -v[1]))[:3]].tolist()
        entries = sorted(merged.values(), key=lambda e: (heaviest(e[0]), e[2]))
        self.vectors = [e[0] for e in entries]
        self.counts = np.array([e[1] for e in entries], dtype=np.int64).reshape(-1, 2)
        self.votes = self.counts * self.class_weight
        self.ids = [e[2] for e in entries]
        self.none = np.array(none) * self.class_weight
        self.index = BlockMaxIndex(self.vectors, len(terms))
        # The entries, one after the other.
        self.start = np.cumsum([0] + [len(t) for t, _ in self.vectors])
        self.entry_terms = np.concatenate([t for t, _ in self.vectors]) if self.vectors else np.zeros(0, dtype=np.int64)
        self.learn_relevance(np.ones(len(entries), dtype=bool))
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.calibrate()

    def __getstate__(self) -> dict:
        """Tasks need the index, not what it was made from."""
        return {k: v for k, v in self.__dict__.items() if k not in ("vectors", "counts", "start", "entry_terms")}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms, ascending, and their weights, of length 1."""
        at, count = self.terms.counts(text)
        w = (1 + np.log(count)) * self.weight[at]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def learn_relevance(self, among: np.ndarray) -> None:
        """Relevance from some of the entries, and all entries under it.

        It is 0.1 for a term whose share of examples is the same in both classes, up to 1 the surer it differs. Equal
        examples are one entry, so copies prove nothing.
        """
        has = (self.counts > 0) & among[:, None]
        total, length = has.sum(axis=0), np.diff(self.start)
        rows = [np.bincount(self.entry_terms[np.repeat(has[:, c], length)], minlength=len(self.weight)) for c in (0, 1)]
        if total.all():
            share = (rows[0] + rows[1]) / total.sum()
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total[0] + 1 / total[1]))
            z = (rows[1] / total[1] - rows[0] / total[0]) / error
            self.relevance = (1 + z * z) / (1 + SURE * SURE + z * z)
        else:
            self.relevance = np.ones(len(self.weight))
        self.length = np.array([np.linalg.norm(w * self.relevance[t]) for t, w in self.vectors])

    def scaled(self, vector: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A vector's weights times the relevance of their terms, of length 1."""
        w = vector[1] * self.relevance[vector[0]]
        return w / np.sqrt((w * w).sum())

    def relevant(self, vector: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The weights whose products with those of an entry sum up to the cosine under relevance times the entry's length."""
        return self.scaled(vector) * self.relevance[vector[0]]

    def relevant_cosines(self, vector: tuple[np.ndarray, np.ndarray], entries: np.ndarray, scaled: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        """The cosines of a text and some entries under relevance: from the postings of the text's terms, which are far fewer
        than the terms of all those entries."""
        if not len(entries):
            return np.zeros(0)
        sums = self.index.sums(vector[0], self.relevant(vector) if scaled is None else scaled, entries, known)
        return np.clip(sums / self.length[entries], 0.0, 1.0)

    def vote(self, vector: tuple[np.ndarray, np.ndarray], without: int = -1, label: int = 0, near: tuple[np.ndarray, np.ndarray] | None = None, scaled: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted share of votes for label 1 among the neighbours, those, their TF-IDF cosines, and the weights of their votes.

        ``without`` leaves one vote of that entry out. ``near`` are the neighbours and cosines, if they were found before,
        ``scaled`` the ``relevant`` weights with their row of the index's ``known``.
        """
        if not len(vector[0]):
            pro, all_ = self.none[1], self.none.sum()
            return (pro + self.prior) / (all_ + 1), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        drop = without if without >= 0 and self.counts[without].sum() == 1 else -1
        at, cosine = near or self.index.nearest(*vector, NEIGHBOURS, drop)
        if not len(at):
            return self.prior, at, cosine, np.zeros(0)
        votes = self.votes[at]
        if without >= 0 and drop < 0:
            votes = votes - (at == without)[:, None] * np.eye(2)[label] * self.class_weight[label]
        away = 1 - self.relevant_cosines(vector, at, scaled, known) + SOFT
        pull = (away.min() / away) ** SHARP
        pro, all_ = float(pull @ votes[:, 1]), float(pull @ votes.sum(axis=1))
        return (pro + PRIOR * self.prior) / (all_ + PRIOR), at, cosine, pull

    def calibrate(self) -> None:
        x, y, w = [], [], []
        fold = np.arange(len(self.vectors)) % FOLDS
        for k in range(FOLDS):
            self.learn_relevance(fold != k)
            for e in np.flatnonzero(fold == k).tolist():
                for label in (0, 1):
                    if n := self.counts[e, label]:
                        x.append(self.vote(self.vectors[e], e, label)[0])
                        y.append(label)
                        w.append(n * self.class_weight[label])
        self.learn_relevance(fold >= 0)
        nothing = np.zeros(0, dtype=np.int64), np.zeros(0)
        for label in (0, 1):
            if self.none[label]:
                x.append(self.vote(nothing)[0])
                y.append(label)
                w.append(self.none[label])
        if len(set(y)) == 2:
            px, py = pooled(np.array(x), np.array(y, dtype=float), np.array(w))
            # Between the levels the curve rises in straight lines; its ends leave room for votes beyond all examples.
            self.curve = (np.r_[0.0, px, 1.0], np.r_[0.0, np.clip(py, 0.001, 0.999), 1.0])

    def score(self, text: str) -> tuple[float, list[str]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, list[str]]]:
        """Score and evidence of each text; one step for all texts after the other, so that the part of the model that a step
        reads stays in the processor's cache."""
        vectors = [self.vector(t) for t in texts]
        found: list[tuple[float, list[str]]] = []
        for at in range(0, len(vectors), TOGETHER):
            some = vectors[at : at + TOGETHER]
            near = [self.index.nearest(*v, NEIGHBOURS, known=k) for v, k in zip(some, self.index.known(some))]
            scaled = [self.relevant(v) if len(v[0]) else v[1] for v in some]
            known = self.index.known([(v[0], w) for v, w in zip(some, scaled)])
            for v, n, w, k in zip(some, near, scaled, known):
                vote = self.vote(v, near=n, scaled=w, known=k)
                # The vote of the text alone decides there, so a text has one score, whichever texts are scored with it.
                found.append(self.judged(*(self.vote(v) if abs(vote[0] * 10**DECIMALS % 1 - 0.5) < NEAR else vote)))
        return found

    def judged(self, raw: float, at: np.ndarray, cosine: np.ndarray, pull: np.ndarray) -> tuple[float, list[str]]:
        first = np.argsort(-pull, kind="stable")[:3]
        evidence = [f"{self.ids[e]}:{int(self.votes[e, 1] > self.votes[e, 0])}:{c:.4f}" for e, c in zip(at[first], cosine[first])]
        return float(np.interp(round(float(raw), DECIMALS), *self.curve)), evidence


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of either class; frequencies are counted over all of ``df``."""
    examples = labelled_sample(df, labels, label_col, per_class, id_col, text_col)
    counted = dict(one_label(labels, id_col, label_col).where(~held_out("_ls_id")).groupBy("_ls_label").count().collect())
    terms = vocabulary(examples)
    rows, frequency = document_frequencies(df, text_col, terms) if terms else (0, np.zeros(0, dtype=np.int64))
    return Model(examples, terms, rows, frequency, (counted.get(0, 0), counted.get(1, 0)))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (1 if score >= 0.5) and evidence (``example id:label:cosine``,
    the three neighbours whose votes weigh most).

    Null and empty texts, and texts without a word of the examples, get the calibrated share of such examples; without
    any labels the score is the prior. Ids may be null or repeat, rows of one text have one score, very long texts are
    scored whole; bytes that are not UTF-8 count as U+FFFD. Other columns are not read; an empty table gives an empty
    result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), readable_text(text_col).alias("_ls_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            found = model.scores(batch.column(1).to_pylist())
            score = pa.array([s for s, _ in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), score, pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.string()))],
                names=["_ls_id", "score", "predicted", "evidence"],
            )

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"_ls_id {kind}, score double, predicted int, evidence array<string>").withColumnRenamed("_ls_id", id_col)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that the model predicts toxic; columns unchanged, no join, null ids stay as they are.

    Null and empty texts are scored as in ``toxicity``; repeated rows share their fate; an empty table stays empty.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            texts = batch.column(at).cast(pa.binary())
            keep = [score < 0.5 for score, _ in model.scores([(t.as_py() or b"").decode("utf-8", "replace") for t in texts])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
