"""Documents that hold every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard int, w string, words binary, run int"


def documents():
    rng = random.Random(3)
    words = ["alpha", "beta", "the", "of", "gamma", "delta", "naïve", "straße", "año", "et,", "zwölf.", "Rot", "IT'S", "don't"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "\n", ".", "  "]) for _ in range(n))
    texts = [make(rng.randint(1, 120)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " changed", None, "", "   \n\t ", "a", "x" * 5000, make(6000), "😀 emoji ‍  nbsp\tand tab", "<|endoftext|> in <|startoftext|>text", "line one here\nline one here\nline one here", "12 34.5 +1 (415) 555-0000 a@b.co 10.0.0.1, 4111 1111 1111 1111", "ΣΑΣ ﬁ Å É"]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or ""), 7, 1, "x", b"y", 3) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "null id text here", "en", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
