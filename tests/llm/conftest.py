import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, h string, p long, spans string, `key` string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), 1, "h", 2, "x", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names operators use inside."""

    def build(texts, ids=None):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty and very long texts, repeated rows, repeated ids, a null id."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", "short", "short", "another short text of that id", "a text without an id", long, "Ünïcödé ﬁ 日本 \x00 \x01", " \n\t "]
    return make(texts, [1, 2, 3, 3, 3, None, 4, 5, 6])


@pytest.fixture(scope="session")
def empty(make, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies and shared passages."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ne", "tu", "ra"], k=rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(3, 150))) for _ in range(30)]
    for i in range(8):
        texts.append(texts[i])
        words = texts[i + 8].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(f"{word()} {passage} {texts[i + 16]}")
    texts.append((passage + " ") * 3)
    return texts
