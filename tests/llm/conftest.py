import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, hash long, kept boolean"


def prose(seed: int, n: int) -> str:
    """Invented words; a text of another seed shares next to nothing with it."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with columns whose names clash with what the operators add."""

    def build(rows):
        full = [(i, t, *(rest + (None, None))[:2], None, 7, 0.5, 3, False) for i, t, *rest in ((*r[:2], *r[2:]) for r in rows) for rest in (tuple(rest),)]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space only, one word, repeated rows and ids, null ids, a very long text."""
    long_text = prose(1, 60_000)
    return [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\r\x0b\x0c ", None, "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (5, "é " * 40 + "\n\nÉ", "fr", "b"), (None, "no id here at all", "en", "c"), (6, long_text, "en", "a"), (7, "a\nb\na\n", "xx", None), (-8, "日本語 😀 \x00 ▁ <|endoftext|> <s>", None, "c"), (9, "x" * 3000, "en", "a")]
