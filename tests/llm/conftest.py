"""Small tables with the awkward cases every operator must define."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, line string, sig binary, __sw_n long, score double"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long_text = "\n".join(words(i, 40) for i in range(120))
    base = words(1, 60)
    near = " ".join([*base.split()[:-1], "changed"])
    texts = [
        (0, base), (1, base.upper()), (2, near), (3, None), (4, ""), (5, "   \n\n  "), (6, "one two"), (7, "one two"),
        (8, long_text), (9, long_text), (9, long_text), (None, "null id text here now"), (None, base), (10, "ÉÈ ß İstanbul Σίσυφος 你好 😀"),
        (11, "a\nb\nc\nd"), (12, "x\na\nb\nc\ny"), (13, "<|endoftext|> x <|startoftext|>"), (14, "The " * 300), (15, "z" * 5000),
    ]
    return [(i, t, None if i == 2 else "en", "s", len(t or ""), 1, "l", b"", 7, 0.5) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
