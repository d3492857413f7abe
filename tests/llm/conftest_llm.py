from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts by id, or from (id, text) pairs."""

    def make(texts, lang="en"):
        rows = texts.items() if isinstance(texts, dict) else texts
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "", "en", "s", 0), (2, None, None, None, None), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27),
        (4, "one two  three four five\nsix", "en", "s", 28), (None, "one two three four five six", "en", "s", 27), (5, "12 +- ... !", "en", "s", 11),
        (6, "é" * 50_000 + " " + prose(1, 20_000), "fr", None, -1), (7, " \n\t ", "de", "s", 4),
    ]
    names = "keep_id group_size kept text_sha256 fp score ids round_trip hits _norm _key _found label component key".split()
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
