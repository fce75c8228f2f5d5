import random

import pytest

#: A table with every awkward thing at once: nulls in every column, empty, blank and long texts, ties, repeated rows, and
#: extra columns whose names clash with those of results and of internals.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, row string, score double"


def rows():
    draw = random.Random(7)
    words = [w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()]
    base = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(12)]
    out = [(i, t, "en", f"s{i % 3}", len(t), "k", "z", "r", 0.5) for i, t in enumerate(base)]
    out += [(100 + i, t.replace(" ", "  ") + "\n", "en", "s1", None, None, None, None, None) for i, t in enumerate(base[:3])]  # equal without white space
    out += [(200, base[4], None, None, 1, "k", "z", "r", None)] * 2  # repeated rows
    out += [(300, None, None, None, None, None, None, None, None), (301, "", "en", "", 0, "", "", "", 0.0), (302, " \t\r\n", "en", None, 4, None, None, None, 1.0)]
    out += [(None, base[5], "en", "s2", 3, None, None, None, None), (None, "only here", None, "s2", 3, None, None, None, None)]
    out += [(400, "x" * 20_000 + " " + " ".join(base) * 20, "en", "s0", 9, None, None, None, None)]
    out += [(500, "Été à Zürich: 日本語 🎉 <|endoftext|> café", "fr", "s2", 9, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
