"""Pairs of texts within a number of edits, for lists of texts that are alike but for their digits.

A kind is a text with every digit replaced by 0, and its texts are the digits put in their places. Two lists of texts of two
kinds are compared at once, in arrays: what begins or ends both kinds is left out, which changes no distance; columns of the
table of distances before the first digit are the same for all texts and are computed once; the others are bits of machine
words (Myers; Hyyrö for words that follow one another), a word for each pair. Where this is long, pairs must first have as many
digits in common, in order, as the distance of the kinds demands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ZERO = ord("0")
#: Pairs in one batch of results, at least, but for the last one.
RESULTS = 65_536
WORDS = ((8, np.uint8), (16, np.uint16), (32, np.uint32))
#: Pairs whose words are worked on at once.
STRETCH = 65_536


def most_edits(longer: int, threshold: float) -> int:
    """The largest distance of two texts, the longer of this length, that reaches the threshold; computed as the score is."""
    most = int((1 - threshold) * longer) + 1
    while most >= 0 and not 1 - most / longer >= threshold:
        most -= 1
    return most


def _word(width: int) -> tuple[int, type]:
    return next((w for w in WORDS if width <= w[0]), (64, np.uint64))


def _codes(kind: str, digits: np.ndarray, varies: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a kind with the digits that all its texts share, ``varies`` at the others; and for these their column in ``digits``."""
    codes = np.frombuffer(kind.encode("utf-32-le"), np.int32).copy()
    at = np.flatnonzero(codes == ZERO)
    column = np.full(len(codes), -1)
    if len(at):
        column[at] = np.arange(len(at))
        codes[at] = np.where((digits == digits[0]).all(axis=0), digits[0].astype(np.int32), varies)
    return codes, column


def _in_order(a: np.ndarray, b: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of b, of a) of the pairs that have ``need`` digits in common, in order: bits of the longest common subsequence."""
    width = a.shape[1]
    _, kind = _word(width)
    has = np.zeros((10, len(a)), kind)
    for i in range(width):
        has[a[:, i] - ZERO, np.arange(len(a))] |= kind(1 << i)
    open_ = np.full((1, 1), np.iinfo(kind).max, kind)
    for i in range(b.shape[1]):
        equal = open_ & has[b[:, i] - ZERO]
        open_ = (open_ + equal) | (open_ - equal)
    return np.nonzero(np.broadcast_to(np.bitwise_count(open_ & kind((1 << width) - 1)) <= width - need, (len(b), len(a))))


def _ends(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """How many places at the beginning, and then at the end, are the same."""
    short = min(len(p), len(q))
    unlike = np.flatnonzero(p[:short] != q[:short])
    head = int(unlike[0]) if len(unlike) else short
    rest = short - head
    unlike = np.flatnonzero(p[len(p) - rest :][::-1] != q[len(q) - rest :][::-1])
    return head, int(unlike[0]) if len(unlike) else rest


def within(p: str, q: str, a: np.ndarray, b: np.ndarray, most: int, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a``, places in ``b`` and distance of the texts of kind ``p`` and those of kind ``q`` that are at most ``most`` edits
    apart. ``a`` and ``b`` have a row of digits for each text; ``apart`` is the distance of the kinds if no digit equals another."""
    x, x_column = _codes(p, a, -1)
    y, y_column = _codes(q, b, -2)
    head, tail = _ends(x, y)
    x, x_column, y, y_column = x[head : len(x) - tail], x_column[head : len(x_column) - tail], y[head : len(y) - tail], y_column[head : len(y_column) - tail]
    shape = len(b), len(a)
    if not len(x) or not len(y):
        d = max(len(x), len(y))
        at_b, at_a = np.nonzero(np.full(shape, d <= most))
        return at_a, at_b, np.full(len(at_a), d)
    varying = np.flatnonzero(y == -2)
    if len(varying) and varying[-1] + 1 < len(y) - varying[0]:
        x, x_column, y, y_column = x[::-1], x_column[::-1], y[::-1], y_column[::-1]
    # The bits of each code point in x, one number for all texts; digits that vary are added for each text below.
    fixed: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        if c >= 0:
            fixed[c] = fixed.get(c, 0) | 1 << i
    own = np.flatnonzero(x == -1)
    width, full = len(x), (1 << len(x)) - 1
    plus, minus, done = full, 0, 0
    codes = y.tolist()
    for c in codes:
        if c == -2 or (len(own) and ZERO <= c < ZERO + 10):
            break
        equal = fixed.get(c, 0)
        zero = (((equal & plus) + plus) ^ plus | equal | minus) & full
        up, down = (minus | ~(zero | plus)) & full, zero & plus
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        done += 1
    if done == len(codes):
        d = len(codes) + plus.bit_count() - minus.bit_count()
        at_b, at_a = np.nonzero(np.full(shape, d <= most))
        return at_a, at_b, np.full(len(at_a), d)
    bits, kind = _word(width)
    words = -(-width // bits)
    has = np.zeros((words, 10, len(a)), kind)
    part = lambda number: [kind(number >> bits * w & (1 << bits) - 1) for w in range(words)]
    for k in range(10):
        if number := fixed.get(ZERO + k, 0):
            has[:, k] = np.array(part(number))[:, None]
    for i in own.tolist():
        has[i // bits, a[:, x_column[i]] - ZERO, np.arange(len(a))] |= kind(1 << i % bits)
    number = b - ZERO if b.shape[1] else b
    ends = part(full)

    def advance(equals) -> np.ndarray:
        """Distances, from what each further column of y equals in each word of x."""
        state = [(np.array([p_]), np.array([m_])) for p_, m_ in zip(part(plus), part(minus))]
        one, top = kind(1), kind(bits - 1)
        for at in range(done, len(codes)):
            up_in, down_in = one, kind(0)
            for w in range(words):
                plus_, minus_ = state[w]
                equal = equals(at, w)
                if w:
                    equal = equal | down_in
                zero = ((equal & plus_) + plus_) ^ plus_
                zero |= equal
                zero = zero | minus_
                up, down = minus_ | ~(zero | plus_), zero & plus_
                if w + 1 < words:
                    up_out, down_out = up >> top, down >> top
                up, down = up << one | up_in, down << one
                if w:
                    down = down | down_in
                state[w] = down | ~(zero | up), up & zero
                if w + 1 < words:
                    up_in, down_in = up_out, down_out
        small = max(width, len(codes)) < 256
        count = (lambda v, w: np.bitwise_count(v & ends[w])) if small else (lambda v, w: np.bitwise_count(v & ends[w]).astype(np.int32))
        d = (np.uint8 if small else np.int32)(len(codes))
        for w, (plus_, minus_) in enumerate(state):
            d = d + count(plus_, w) - count(minus_, w)
        return d

    def same(at: int) -> list | None:
        """The words of a column that is one code point for all pairs."""
        return part(fixed.get(codes[at], 0)) if codes[at] != -2 and not (len(own) and ZERO <= codes[at] < ZERO + 10) else None

    alike = {at: s for at in range(done, len(codes)) if (s := same(at)) is not None}
    need = apart - most
    if need > 0 and width > 8 and 0 < a.shape[1] <= 64:
        at_b, at_a = _in_order(a, b, need)
        found = []
        for i in range(0, len(at_a), STRETCH):
            of_b, of_a = at_b[i : i + STRETCH], at_a[i : i + STRETCH]

            def equals(at: int, w: int) -> np.ndarray:
                if at in alike:
                    return alike[at][w]
                if codes[at] >= 0:
                    return has[w, codes[at] - ZERO].take(of_a)
                return has[w].ravel().take(number[:, y_column[at]].astype(np.int64).take(of_b) * len(a) + of_a)

            d = np.broadcast_to(advance(equals), len(of_a))
            keep = np.flatnonzero(d <= most)
            found.append((of_a[keep], of_b[keep], d[keep]))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (at_a, at_b, np.zeros(0, np.uint8))

    def equals_all(at: int, w: int) -> np.ndarray:
        if at in alike:
            return alike[at][w]
        return has[w, codes[at] - ZERO] if codes[at] >= 0 else has[w].take(number[:, y_column[at]], axis=0)

    d = np.broadcast_to(advance(equals_all), shape)
    at_b, at_a = np.nonzero(d <= most)
    return at_a, at_b, d[at_b, at_a]


def _lists(ids: pa.Array, digits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of each list, and a row of digits for each id."""
    offsets, values = ids.offsets.to_pylist(), ids.values.to_numpy()
    for start, end, text in zip(offsets, offsets[1:], digits.to_pylist()):
        yield values[start:end], np.frombuffer(text.encode("ascii"), np.uint8).reshape(end - start, -1)


def similar_members(threshold: float, both: bool):
    """For mapInArrow over (text_a, text_b, apart, itself, ids_a, digits_a, ids_b, digits_b), two lists of texts of two kinds a row: (a, b, score)
    of their pairs that reach the threshold. Of a list that meets ``itself`` each pair comes once; if not ``both``, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def out() -> pa.RecordBatch:
            a, b, score = (np.concatenate(h) for h in zip(*held))
            if not both:
                a, b = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["a", "b", "score"])

        for batch in batches:
            p, q, apart, itself, ids_a, digits_a, ids_b, digits_b = batch.columns
            pairs = zip(p.to_pylist(), q.to_pylist(), apart.to_pylist(), itself.to_pylist(), _lists(ids_a, digits_a), _lists(ids_b, digits_b))
            for kind_a, kind_b, distance, same, (i, a), (j, b) in pairs:
                longer = max(len(kind_a), len(kind_b))
                if not longer:
                    at_b, at_a = np.nonzero(np.ones((len(j), len(i)), bool))
                    d = np.zeros(len(at_a))
                else:
                    at_a, at_b, d = within(kind_a, kind_b, a, b, most_edits(longer, threshold), distance)
                if same:
                    once = at_a < at_b
                    at_a, at_b, d = at_a[once], at_b[once], d[once]
                if len(at_a):
                    held.append((i[at_a], j[at_b], 1 - d / max(longer, 1)))
                    rows += len(at_a)
                if rows >= RESULTS:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return run
