"""Quality classification with a byte-level convolutional network, in numpy.

Learned filters slide over every byte of the UTF-8 text. Their responses are max-pooled over chunks of ``2 * HALF`` bytes
that overlap by half, rectified, and summed up over the whole document (mean and maximum over its chunks); a logistic
layer makes one probability of that. A filter over bytes is a table of weights for each of its places, so a convolution
is ``WIDTH`` table look-ups, a window of the text at a time; what is kept of a text is one row of maxima a half chunk, half a
byte for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import held_out, labelled_sample, one_label, parts, read_table, text_or_empty

#: Bounds the labelled rows of either class that are learned from.
PER_CLASS = 1200
FILTERS, WIDTH, HALF = 16, 6, 128
EPOCHS, RATE, SEED = 8, 0.01, 42
WINDOW_HALVES = 64


class Network:
    """Filters (place, byte, filter), their biases, and the logistic layer over 2 * FILTERS pooled features."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.filters = draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.weights = draw.normal(0, 0.1, 2 * FILTERS)
        self.offset = 0.0

    def halves(self, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter over each half chunk (rows), and with ``where`` its place in the text.

        The last half chunk is padded with zero bytes; a filter may reach over the end of its half into the next.
        """
        n = max(1, -(-len(data) // HALF))
        top = np.empty((n, FILTERS), dtype=np.float32)
        place = np.empty((n, FILTERS), dtype=np.int64) if where else None
        for at in range(0, n, WINDOW_HALVES):
            end = min(n, at + WINDOW_HALVES)
            size = (end - at) * HALF
            window = data[at * HALF : at * HALF + size + WIDTH - 1]
            padded = np.zeros(size + WIDTH - 1, dtype=np.intp)
            padded[: len(window)] = window
            total = np.take(self.filters[0], padded[:size], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.filters[j], padded[j : j + size], axis=0)
            cube = total.reshape(end - at, HALF, FILTERS)
            if where:
                best = cube.argmax(axis=1)
                place[at:end] = best + (np.arange(at, end) * HALF)[:, None]
                top[at:end] = np.take_along_axis(cube, best[:, None, :], axis=1)[:, 0]
            else:
                top[at:end] = cube.max(axis=1)
        return top + self.bias, place

    @staticmethod
    def chunks(top: np.ndarray) -> np.ndarray:
        """Rectified maxima of overlapping chunks: two neighbouring halves each; a text of one half is one chunk."""
        return np.maximum(np.maximum(top[:-1], top[1:]) if len(top) > 1 else top, 0)

    def features(self, top: np.ndarray) -> np.ndarray:
        pooled = self.chunks(top)
        return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]).astype(np.float64)

    def probability(self, text: bytes) -> float:
        z = float(self.features(self.halves(np.frombuffer(text, dtype=np.uint8))[0]) @ self.weights + self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, examples: list[tuple[bytes, int]], class_weight: tuple[float, float], epochs: int = EPOCHS) -> None:
        """Adam on the weighted log loss; gradients reach a filter only where it was the maximum."""
        draw = np.random.default_rng(SEED)
        state = {k: [np.zeros_like(np.asarray(v, dtype=np.float64)), np.zeros_like(np.asarray(v, dtype=np.float64))] for k, v in (("filters", self.filters), ("bias", self.bias), ("weights", self.weights), ("offset", 0.0))}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = draw.permutation(len(examples))
            for at in range(0, len(order), 16):
                batch = order[at : at + 16]
                grad = {"filters": np.zeros_like(self.filters, dtype=np.float64), "bias": np.zeros(FILTERS), "weights": np.zeros(2 * FILTERS), "offset": 0.0}
                for e in batch:
                    self._gradient(examples[e], class_weight, grad)
                step += 1
                for k, g in grad.items():
                    g = np.asarray(g) / len(batch)
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    value = getattr(self, k) - move
                    setattr(self, k, value.astype(np.float32) if k in ("filters", "bias") else (float(value) if k == "offset" else value))

    def _gradient(self, example: tuple[bytes, int], class_weight: tuple[float, float], grad: dict) -> None:
        text, label = example
        data = np.frombuffer(text, dtype=np.uint8)
        top, place = self.halves(data, where=True)
        pooled = self.chunks(top)
        features = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]).astype(np.float64)
        z = float(features @ self.weights + self.offset)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * class_weight[label]
        grad["weights"] += error * features
        grad["offset"] += error
        back = np.repeat(self.weights[None, :FILTERS] * error / len(pooled), len(pooled), axis=0)
        back[pooled.argmax(axis=0), np.arange(FILTERS)] += self.weights[FILTERS:] * error
        back *= pooled > 0
        if len(top) > 1:
            second = top[1:] > top[:-1]
            by_half = np.zeros_like(top, dtype=np.float64)
            by_half[:-1] += np.where(second, 0, back)
            by_half[1:] += np.where(second, back, 0)
        else:
            by_half = back
        half, column = np.nonzero(by_half)
        g, at = by_half[half, column], place[half, column]
        grad["bias"] += np.bincount(column, g, FILTERS)
        for j in range(WIDTH):
            byte = np.where(at + j < len(data), data[np.minimum(at + j, max(0, len(data) - 1))] if len(data) else 0, 0)
            np.add.at(grad["filters"][j], (byte, column), g)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Network:
    """Learn from whole texts of at most ``per_class`` labelled rows of either class, weighted to the labels' true shares."""
    examples = labelled_sample(df, labels, label_col, per_class, id_col, text_col)
    counted = dict(one_label(labels, id_col, label_col).where(~held_out("_ls_id")).groupBy("_ls_label").count().collect())
    sampled = [sum(y == c for _, _, y in examples) for c in (0, 1)]
    total = sum(counted.get(c, 0) for c in (0, 1))
    weight = tuple(counted.get(c, 0) / total * sum(sampled) / n if n else 0.0 for c, n in enumerate(sampled)) if total else (1.0, 1.0)
    network = Network()
    # Copies say nothing new: one of each text and label is learned from.
    distinct = sorted({(t.encode(), y) for _, t, y in examples})
    network.train(distinct, weight)
    return network


def quality(df: DataFrame, network: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (1 if score >= ``threshold``).

    Null text counts as empty, which is scored like any other (one chunk of padding). Very long texts are scored whole, in
    windows. Ids may be null or repeat; other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), text_or_empty(text_col).cast("binary").alias("_ls_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            score = np.fromiter((network.probability(t.as_py()) for t in batch.column(1)), dtype=np.float64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["_ls_id", "score", "predicted"])

    return rows.mapInArrow(run, f"_ls_id {rows.schema[0].dataType.simpleString()}, score double, predicted int").withColumnRenamed("_ls_id", id_col)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    network = fit(docs, read_table(spark, sf_dir, "labels"))
    return quality(docs, network).select("doc_id", held_out().alias("held_out"), "score", "predicted")
