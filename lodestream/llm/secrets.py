"""Secret scan: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags the pieces of every line as begin, inside or outside of a secret. Pieces end at white space, quotes,
brackets and the marks ``= : , ; & |``, so a value stands apart from what it is assigned to. Features are a piece's shape,
length, mix and variety of characters, all of them over the whole piece, the words on either side, whether the piece
before assigns, and the kind of file (length, share of digits, of ``=`` signs).

It is trained by maximum likelihood (forward-backward) on a bounded sample of texts, taken apart for texts with each kind
of base span and for others. The patterns' own finds are labels; since these all look alike, every such line is also
learned with another value (of another alphabet, length and prefix) behind another word or none, and other lines with a
value put in, or with ordinary things put in that only look odd: dates, numbers, addresses, links, names of code and
files. So the field learns what secrets look like, and not what the patterns look for. Viterbi decodes.

A piece's share of every score depends on the piece alone, so it is kept in a bounded cache. A line is decoded only if
some piece could be anything but outside at all: if for every piece the gain of leaving "outside" is below twice the
largest gain of a transition, no path can pay for the two transitions that it needs, and all are outside - exactly.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import parts, read_table, readable_text, settle, texts_of

#: Bounds the texts that the field is trained on: of each kind of base span, and of texts without any; and their bytes.
MARKED_ROWS, PLAIN_ROWS, TRAIN_BYTES = 500, 2000, 12_000_000
#: Bounds the lines of training (a line is learned in windows of so many pieces), and the variants of each marked one.
MARKED_LINES, PLAIN_LINES, WINDOW, VARIANTS = 1000, 3000, 120, 3
FEATURES, EPOCHS, RATE, DECAY = 1 << 13, 6, 0.05, 1e-4
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
CACHE_WORDS = 400_000
KINDS = ("assign", "access", "hex", "crf")
PIECE = re.compile(r"""\n|[^\s"'=:,;&(){}\[\]<>|]+["':=]*|[=:]+""")
MARKS = "\"':="

# The base patterns and the least lengths of what they find.
ASSIGN_WORDS = "(password|passwd|secret|token|api_?key)"
ASSIGN = re.compile(ASSIGN_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind: leftmost non-overlapping matches of each kind that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % (FEATURES - 1) + 1  # 0 is padding


class _Classes(dict):
    """Translation of characters: digits to 0, upper case to A, other letters to a; the rest stays."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        self[point] = ord("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c)
        return self[point]


CLASSES = _Classes()
ASCII_CLASSES = bytes(CLASSES[c] for c in range(256))
NOT_HEX = {c: None for c in map(ord, "0123456789abcdefABCDEF")}
RUN = re.compile(r"(.)\1*", re.DOTALL)
NOT_LETTERS = re.compile("[^a-z]+")


def outline(word: str) -> str | bytes:
    """The classes of a piece's characters."""
    return word.encode().translate(ASCII_CLASSES) if word.isascii() else word.translate(CLASSES)


def signature(word: str) -> tuple:
    """What a piece's own features depend on: size, shape and mixture of characters of all of it, and whether it assigns."""
    body = word.rstrip(MARKS)
    n = len(body)
    if not n:
        return (0,) * 11 + (True,)
    classes = body.translate(CLASSES)
    runs = [len(m.group()) for m in RUN.finditer(classes)]
    digits, upper, lower = (classes.count(c) for c in "0Aa")
    shape = RUN.sub(r"\1", classes) if len(runs) <= 6 else "many"
    hexed = (n - len(body.translate(NOT_HEX))) * 5 // n if digits else 0
    kinds = min(len(set(body)), 40) // 3 if digits or n > 15 else 0
    other = n - digits - upper - lower
    return (
        min(n, 80) // 4 + 1, shape, digits * 6 // n, upper * 6 // n, hexed, kinds, len(runs) * 6 // n, min(max(runs), 16) // 2, min(other, 4), "." in body or "/" in body or "@" in body, digits > 0 and upper + lower > 0, "=" in word[n:] or ":" in word[n:]
    )


def lead_of(word: str) -> str:
    """The last run of letters of what may lead to a secret: ``pwd`` of ``DB_PWD=``."""
    word = word.lower()
    if word.isalpha() and word.isascii():
        return word
    runs = [x for x in NOT_LETTERS.split(word) if x]
    return runs[-1] if runs else ""


def signature_features(sig: tuple) -> tuple[list[int], list[int], list[int]]:
    """Features of a piece for itself, for the piece after it, and for the piece before it."""
    size, shape, digits, upper, hexed, kinds, turns, longest, other, path, mixed, assigns = sig
    some = min(size // 3, 4)
    own = [
        f"n{size}", f"s{shape}", f"d{digits}.{some}", f"u{upper}.{some}", f"du{digits}.{upper}.{some}", f"h{hexed}.{some}", f"k{kinds}.{some}", f"t{turns}.{some}", f"l{longest}.{some}",
        f"o{other}.{path}", f"m{mixed}.{turns}.{some}", f"x{mixed}.{path}.{some}", f"a{assigns}",
    ]
    return [_feature(x) for x in own], [_feature(f"<s{shape}"), _feature(f"<a{assigns}"), _feature(f"<as{assigns}.{size > 0}")], [_feature(f">s{shape}")]


def file_features(text: str) -> list[int]:
    n = max(1, len(text))
    digits = sum(text.count(x) for x in "0123456789") / n
    return [_feature(f"f{n.bit_length() // 2}"), _feature(f"fd{int(min(digits, 0.2) * 50)}"), _feature(f"f={min(text.count('=') * 1000 // n, 10)}")]


class Field:
    """Weights of features (feature, tag) and of transitions (from, to); a line starts and ends outside."""

    def __init__(self) -> None:
        self.weights = np.zeros((FEATURES, 3))
        self.moves = np.zeros((3, 3))
        self.moves[OUTSIDE, INSIDE] = -1e4
        self.trained = False
        self.leads: dict[str, int] = {}  # last letters of pieces before a secret in training -> feature

    # --- training ------------------------------------------------------------------------------------------------

    def train(self, lines: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> None:
        """Lines of (features of each token, tags). Padded batches; Adam on the negative log likelihood."""
        if not any(any(tags) for _, tags in lines):
            return
        draw = np.random.default_rng(42)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i][1]))
        batches = [order[i : i + 64] for i in range(0, len(order), 64)]
        m_w, v_w, m_t, v_t = np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros((3, 3)), np.zeros((3, 3))
        step = 0
        for epoch in range(epochs):
            for at in draw.permutation(len(batches)):
                part = [lines[i] for i in batches[at]]
                g_w, g_t = self._gradient(part)
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for g, m, v, x in ((g_w + DECAY * self.weights, m_w, v_w, self.weights), (g_t, m_t, v_t, self.moves)):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                self.weights[0] = 0
                self.moves[OUTSIDE, INSIDE] = -1e4
        self.trained = True

    def _gradient(self, lines: list[tuple[list[list[int]], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(lines), max(len(t) for _, t in lines)
        width = max(len(f) for feats, _ in lines for f in feats)
        feats = np.zeros((n, longest, width), dtype=np.int64)
        tags = np.zeros((n, longest), dtype=np.int64)
        mask = np.zeros((n, longest), dtype=bool)
        for i, (f, t) in enumerate(lines):
            mask[i, : len(t)], tags[i, : len(t)] = True, t
            for j, x in enumerate(f):
                feats[i, j, : len(x)] = x
        emit = self.weights[feats].sum(axis=2)
        # Padding is outside for sure, so a line ends outside whatever its length.
        emit[~mask] = [0.0, -1e4, -1e4]

        def total(x: np.ndarray) -> np.ndarray:
            top = x.max(axis=1, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]

        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = self.moves[OUTSIDE] + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = total(ahead[:, t - 1, :, None] + self.moves[None]) + emit[:, t]
        behind[:, -1] = self.moves[:, OUTSIDE]
        for t in range(longest - 2, -1, -1):
            behind[:, t] = total((self.moves.T[None] + (emit[:, t + 1] + behind[:, t + 1])[:, :, None]))
        whole = total((ahead[:, -1] + behind[:, -1])[:, :, None])[:, 0]
        share = np.exp(ahead + behind - whole[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + self.moves[None, None] + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        error = share - np.eye(3)[tags]
        error[~mask] = 0
        g_w = np.zeros_like(self.weights)
        for k in range(3):
            g_w[:, k] = np.bincount(feats.ravel(), np.repeat(error[:, :, k].ravel(), width), FEATURES)
        g_t = pair.sum(axis=(0, 1))
        np.subtract.at(g_t, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g_t[OUTSIDE] += share[:, 0].sum(axis=0)
        np.subtract.at(g_t[OUTSIDE], tags[:, 0], 1)
        return g_w / n, g_t / n

    # --- decoding ------------------------------------------------------------------------------------------------

    def viterbi(self, emit: list[list[float]]) -> list[int]:
        """The best tags of a line."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        o, b, i = emit[0][0] + oo, emit[0][1] + ob, -1e9
        back = []
        for eo, eb, ei in emit[1:]:
            to_o, to_b = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib)
            to_i = (-1e9, b + bi, i + ii)
            back.append((to_o.index(max(to_o)), to_b.index(max(to_b)), to_i.index(max(to_i))))
            o, b, i = max(to_o) + eo, max(to_b) + eb, max(to_i) + ei
        last = (o + oo, b + bo, i + io)
        tag = last.index(max(last))
        tags = [tag]
        for step in reversed(back):
            tag = step[tag]
            tags.append(tag)
        return tags[::-1]


class Scanner:
    """Applies a field to texts; keeps each token's share of the scores in a bounded cache."""

    def __init__(self, field: Field):
        self.field = field
        gains = field.moves - field.moves[OUTSIDE, OUTSIDE]
        self.least = -2 * max(0.0, float(gains.max()))
        self.clear()

    def clear(self) -> None:
        # The end of a line is row 0, as is what lies before the first and after the last piece.
        self.known: dict[str, int] = {"\n": 0}
        self.rows: dict[object, int] = {}  # outline or signature -> row of the table
        w = self.field.weights
        self.table = np.zeros((1024, 9))
        self.table[0] = np.concatenate([np.zeros(3), w[_feature("<^")], w[_feature(">$")]])
        self.used = 1

    def row(self, word: str) -> int:
        """The row of the table with a piece's scores for itself (0-2), the piece after it (3-5) and before it (6-8)."""
        lead = self.field.leads.get(lead_of(word))
        if lead is None and len(word) < 16 and word.isascii() and word.isalpha() and (word.islower() or word.istitle()):
            key = (len(word), word.islower())
            found = self.rows.get(key)
            if found is None:
                found = self.rows[key] = self.new_row((signature(word), None))
            return found
        key = outline(word)
        # The features of a short piece without digits depend on its outline alone.
        plain = lead is None and len(word) < 16 and ("0" if isinstance(key, str) else b"0") not in key
        found = self.rows.get(key) if plain else None
        if found is None:
            found = self.new_row((signature(word), lead))
            if plain:
                self.rows[key] = found
        return found

    def new_row(self, full: tuple) -> int:
        """The row of a signature and a lead, made if it is new."""
        found = self.rows.get(full)
        if found is None:
            found = self.rows[full] = self.used
            if found == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            own, after, before = signature_features(full[0])
            w = self.field.weights
            self.table[found] = np.concatenate([w[own].sum(axis=0), w[after + ([full[1]] if full[1] else [])].sum(axis=0), w[before].sum(axis=0)])
            self.used += 1
        return found

    def places(self, words: list[str]) -> np.ndarray:
        known, row = self.known, self.row
        for word in set(words).difference(known):
            known[word] = row(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the runs that the field tags, in code points."""
        if len(self.known) > CACHE_WORDS or len(self.rows) > CACHE_WORDS:
            self.clear()
        pieces = PIECE.findall(text)
        if not pieces:
            return []
        at = self.places(pieces)
        emit = self.table[:, :3].take(at, axis=0)
        emit[1:] += self.table[:, 3:6].take(at[:-1], axis=0)
        emit[:-1] += self.table[:, 6:].take(at[1:], axis=0)
        emit[0] += self.table[0, 3:6]
        emit[-1] += self.table[0, 6:]
        emit += self.field.weights[file_features(text)].sum(axis=0)
        hot = np.flatnonzero((np.maximum(emit[:, BEGIN], emit[:, INSIDE]) - emit[:, OUTSIDE] >= self.least) & (at > 0))
        if not len(hot):
            return []
        ends = np.r_[np.flatnonzero(at == 0), len(at)]
        tags = np.zeros(len(pieces), dtype=np.int64)
        for line in np.unique(np.searchsorted(ends, hot)).tolist():
            a, b = ends[line - 1] + 1 if line else 0, ends[line]
            tags[a:b] = self.field.viterbi(emit[a:b].tolist())
        if not tags.any():
            return []
        found: list[list[int]] = []
        for tag, m in zip(tags.tolist(), PIECE.finditer(text)):
            if tag == BEGIN:
                found.append([m.start(), end_of(m)])
            elif tag == INSIDE:
                found[-1][1] = end_of(m)
        return [(a, 3, b) for a, b in found]


def end_of(piece: re.Match) -> int:
    """Where a secret ends in its piece: behind its ``=`` signs (padding), before other marks."""
    word = piece.group()
    body = len(word.rstrip(MARKS))
    return piece.start() + body + len(word[body:]) - len(word[body:].lstrip("="))


# Alphabets, prefixes and leading words of the values that variants are made with.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LEADING = "password passwd pwd pass passphrase secret token key auth bearer credential authorization private access api client session signature login".split()


def drawn_value(draw: random.Random) -> str:
    """A secret as they come: hex, base 32, 62 or 64, with a prefix, in groups, signed tokens, passwords."""

    def run(alphabet: str, least: int, most: int) -> str:
        return "".join(draw.choices(alphabet, k=draw.randint(least, most)))

    def prefix() -> str:
        return draw.choice(["_", "-"]).join(run(LOWER, 2, 5) for _ in range(draw.randint(1, 2))) + draw.choice(["_", "-"])

    both = LOWER + UPPER + DIGITS
    kind = draw.randrange(9)
    if kind == 0:
        return run(DIGITS + "abcdef", 20, 64)
    if kind == 1:
        return run(DIGITS + "ABCDEF", 16, 64)
    if kind == 2:
        return run(both, 16, 48)
    if kind == 3:
        return prefix() + run(both, 14, 40)
    if kind == 4:
        return run(both + "+/", 24, 64) + draw.choice(["", "=", "=="])
    if kind == 5:
        return run(UPPER + "234567", 16, 40)
    if kind == 6:
        return prefix() + "-".join(run(draw.choice([DIGITS, both]), 8, 16) for _ in range(2)) + "-" + run(both, 12, 28)
    if kind == 7:
        return ".".join("eyJ" * (i == 0) + run(both + "_-", 16, 48) for i in range(3))
    return run(both + "!@#$%^*+-_.~", 12, 20)


def drawn_filler(draw: random.Random, words: list[str]) -> str:
    """Something ordinary that looks odd: numbers, dates, addresses, links, names of code and files, runs of words."""
    n = lambda a, b: str(draw.randint(a, b))
    w = lambda: draw.choice(words)
    part = lambda: draw.choice([w, w, lambda: n(0, 10 ** draw.randint(1, 6)), lambda: f"{w()}-{w()}", lambda: f"{w()}_{n(1, 99)}", lambda: f"{w()}-{w()}-{n(1, 9999)}"])()
    path = lambda: "".join("/" + part() for _ in range(draw.randint(1, 5)))
    kinds = [
        lambda: n(0, 10 ** draw.randint(1, 19)),
        lambda: f"{n(1900, 2099)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}:{n(10, 59)}:{n(10, 59)}Z",
        lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}",
        lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}",
        lambda: draw.choice(["https://", "http://", "//", "ftp://"]) + draw.choice(["www.", ""]) + w() + draw.choice([".example.com", ".org", ".net:8080"]) + path() + draw.choice(["", "/", f"?{w()}={n(1, 99)}", f"?{w()}={w()}&{w()}={n(1, 9999)}"]),
        lambda: path() + draw.choice(["", f"/{w()}.{w()[:3]}"]),
        lambda: f"{w()}{draw.choice(['', '.', '_', '-'])}{draw.choice([w(), n(1, 9999)])}@{w()}{draw.choice(['', n(1, 9)])}.{draw.choice(['example.com', 'org', 'co.uk'])}",
        lambda: "".join(w().capitalize() for _ in range(draw.randint(2, 4))) + draw.choice(["", n(1, 99)]),
        lambda: "_".join(w() for _ in range(draw.randint(2, 4))) + draw.choice(["", "_" + n(1, 99)]),
        lambda: "-".join(w() for _ in range(draw.randint(2, 5))),
        lambda: "_".join(w() for _ in range(draw.randint(1, 3))).upper(),
        lambda: "".join(w() for _ in range(draw.randint(2, 5))),
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}-{w()[:4]}{n(1, 9)}",
        lambda: f"{draw.choice(UPPER)}{draw.choice(UPPER)}{n(10, 99)} {n(1000, 9999)} {n(1000, 9999)} {n(1000, 9999)} {n(1000, 9999)}",
        lambda: f"{draw.choice(UPPER)}{draw.choice(UPPER)}{n(10**15, 10**18)}",
        lambda: f"{w()} = {w()}",
        lambda: f"{draw.choice(LEADING)}: {w()}",
        lambda: f"#{n(100000, 999999)}",
    ]
    return draw.choice(kinds)()


Line = tuple[list[str], list[int], tuple[int, ...]]


def value_spans(text: str) -> list[tuple[int, int]]:
    """The values that base spans hold, without what they are assigned to."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return found + [(a, b) for a, kind, b in base_spans(text) if kind and not any(x <= a < y for x, y in found)]


def tagged(line: str, values: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The pieces of a line and their tags: what overlaps a value begins it, or is inside."""
    words, tags, open_ = [], [], None
    for m in PIECE.finditer(line):
        end = end_of(m)
        mine = next((v for v in values if v[0] < end and v[1] > m.start()), None)
        words.append(m.group())
        tags.append(OUTSIDE if mine is None else INSIDE if mine == open_ else BEGIN)
        open_ = mine
    return words, tags


def training_lines(texts: list[tuple[int, str]]) -> list[Line]:
    """Lines with base spans and their variants, and others with and without values or fillers put in."""
    draw = random.Random(42)
    marked, plain = [], []
    for _, text in texts:
        about = tuple(file_features(text))
        values = sorted(value_spans(text))
        at = 0
        for line in text.split("\n"):
            mine = [(a - at, b - at) for a, b in values if a >= at and b <= at + len(line)]
            touched = mine or any(a < at + len(line) and b > at for a, b in values)
            if mine:
                marked.append((line, mine, about))
            elif line.strip() and not touched:
                plain.append((line, [], about))
            at += len(line) + 1
    order = lambda x: (zlib.crc32(x[0].encode()), x[0], x[2])
    marked, plain = sorted(marked, key=order)[:MARKED_LINES], sorted(plain, key=order)[:PLAIN_LINES]
    if not marked:
        return []
    words = [w.lower() for line, _, _ in plain[:500] for w in line.split() if w.isalpha()] or list(LEADING)
    lines = marked + plain
    for line, values, about in marked:
        a, b = values[0]
        for _ in range(VARIANTS):
            value = drawn_value(draw)
            ahead = ASSIGN_TAIL.search(line, 0, a)
            begin = ahead.start() if ahead else a
            lead = draw.choice(["", draw.choice(words) + " ", draw.choice(words) + " ", draw.choice(LEADING) + draw.choice([" ", ": ", "=", " = ", '="']), "_".join([draw.choice(words).upper(), draw.choice(LEADING).upper()]) + "="])
            lines.append((line[:begin] + lead + value + line[b:], [(begin + len(lead), begin + len(lead) + len(value))], about))
    for n, (line, _, about) in enumerate(plain):
        cut = [m.start() for m in re.finditer(r"\S+", line)]
        for _ in range(2):
            where = draw.choice(cut)
            filler = drawn_filler(draw, words) + " "
            lines.append((line[:where] + filler + line[where:], [], about))
        if n % 3 == 0:
            where, value = draw.choice(cut), drawn_value(draw)
            lead = draw.choice(["", draw.choice(LEADING) + draw.choice([" ", ": ", "=", ' = "']), draw.choice(words) + draw.choice([" ", " ", ": ", "="])])
            lead = draw.choice(["", drawn_filler(draw, words) + " "]) + lead
            lines.append((line[:where] + lead + value + " " + line[where:], [(where + len(lead), where + len(lead) + len(value))], about))
    out = []
    for line, values, about in lines:
        pieces, tags = tagged(line, values)
        for i in range(0, len(pieces), WINDOW):
            tag = tags[i : i + WINDOW]
            if tag[0] == INSIDE:
                tag[0] = BEGIN
            out.append((pieces[i : i + WINDOW], tag, about))
    return out


# What stands between the word that a base span begins with and its value.
ASSIGN_TAIL = re.compile(r"""\S*["']?\x20*[:=]\x20*["']?$""")


def featured(lines: list[Line]) -> tuple[list[tuple[list[list[int]], list[int]]], dict[str, int]]:
    """The features of every piece of the lines with their tags, and the features of words that lead to secrets."""
    leads = {lead_of(w): _feature("<w" + lead_of(w)) for words, tags, _ in lines for w, tag in zip(words, tags[1:]) if tag == BEGIN and lead_of(w)}
    out, known = [], {}
    for words, tags, about in lines:
        look = []
        for w in words:
            if w not in known:
                own, after, before = signature_features(signature(w))
                lead = leads.get(lead_of(w))
                known[w] = own, after + ([lead] if lead else []), before
            look.append(known[w])
        look = [([], [_feature("<^")], []), *look, ([], [], [_feature(">$")])]
        out.append(([look[j][0] + look[j - 1][1] + look[j + 1][2] + list(about) for j in range(1, len(look) - 1)], tags))
    return out, leads


def sampled(df: DataFrame, id_col: str, text_col: str, marked: int = MARKED_ROWS, plain: int = PLAIN_ROWS) -> list[tuple[int, str]]:
    """Texts to train on, by the hash of the id: so many with each kind of base span, and so many without any."""
    text = readable_text(text_col)
    # A mark of assignment and some digits are quicker to look for than the patterns, and prose lacks one of them mostly.
    digits = text.rlike("[0-9][0-9a-f]")
    has = [
        (text.contains("=") | text.contains(":")) & text.rlike(f"(?i){ASSIGN_WORDS}.{{0,9}}[A-Za-z0-9+/_.=-]{{{ASSIGN_LEAST},}}"),
        text.contains("AKIA") & text.rlike(f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"),
        digits & text.rlike(HEX.pattern),
    ]
    flags = settle(df.select(F.col(f"`{id_col}`").alias("_ls_id"), *[x.alias(f"_ls_{i}") for i, x in enumerate(has)]).where("_ls_id is not null"))
    order = F.xxhash64(F.lit("sample"), "_ls_id"), F.col("_ls_id")
    groups = [flags.where(f"_ls_{i}").orderBy(*order).limit(marked) for i in range(3)] + [flags.where("not (_ls_0 or _ls_1 or _ls_2)").orderBy(*order).limit(plain)]
    ids = sorted({r["_ls_id"] for g in groups for r in g.select("_ls_id").collect()})
    return texts_of(df, ids, flags.schema["_ls_id"].dataType, id_col, text_col, TRAIN_BYTES)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field trained on a bounded sample; untrained, and then adding nothing, if no text has a base span."""
    field = Field()
    lines, field.leads = featured(training_lines(sampled(df, id_col, text_col)))
    field.train(lines)
    return field


def apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``spans``, none of which overlaps another, that overlap none of ``others``: one pass over both by their starts."""
    out, at, reach = [], 0, 0
    others = sorted(others)
    for span in sorted(spans):
        while at < len(others) and others[at][0] < span[2]:
            reach = max(reach, others[at][2])
            at += 1
        if reach <= span[0]:
            out.append(span)
    return out


def find_secrets(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (array of kind, start, end in code points; end exclusive), base spans first found
    by pattern, and those of kind ``crf`` that overlap no base span; by start, then kind.

    Null text counts as empty and has none. Ids may be null or repeat; very long texts and pieces are read whole; bytes
    that are not UTF-8 count as U+FFFD. Other columns are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("_ls_id"), readable_text(text_col).alias("_ls_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field) if field.trained else None
        for batch in parts(batches, 1):
            out = []
            for t in batch.column(1):
                text = t.as_py()
                spans = base_spans(text)
                if scanner:
                    spans = sorted(spans + apart(scanner.spans(text), spans))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["_ls_id", "spans"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"_ls_id {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("_ls_id", id_col)


def redact(df: DataFrame, field: Field, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of the text replaced by ``mark``; other columns unchanged.

    Null text stays null, empty text empty; repeated rows and rows without an id are redacted alike, an empty table stays
    empty.
    """
    at = df.columns.index(text_col)

    def cleaned(scanner: Scanner | None, text: str) -> str:
        out, end = [], 0
        for a, _, b in sorted(base_spans(text) + (scanner.spans(text) if scanner else [])):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field) if field.trained else None
        for batch in parts(batches, at):
            texts = [None if (x := t.as_py()) is None else cleaned(scanner, x) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
