import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, doc string, row int, _slot int, rep string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, 2, "r") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(700)]

    def make(words, seed):
        r = random.Random(seed)
        out = [r.choice(lexicon) for _ in range(words)]
        for k in range(12, words, 13):
            out[k] += ".\n" if k % 2 else "."
        return " ".join(out).replace("\n ", "\n")

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and white texts, a very long one, repeated rows and ids."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "no id"), (4, prose(60, 1)), (4, prose(60, 1)), (5, prose(60, 1)), (6, "<|endoftext|> it's 12 ½ Éé 日本 🙂 ▁ x"), (7, prose(30_000, 2)),
        (8, "a" * 5000), (9, "one"), (10, "one two three"), (11, "One  two\nthree"),
    ]
