from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, lot int, line string, row int, size int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Null fields, empty and long texts, ties, repeated rows, and extra columns whose names operators might use."""
    rnd = random.Random(7)
    words = ["the", "of", "tiou", "Straße", "漢字", "word,", "naïve", "x", "▁mark", "a\tb", "longer"]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "ONE two three", "  spaced   out \n\n text ", "\0zero ▁ under"]
    shared = " ".join(rnd.choice(words) + str(i) for i in range(60))
    for _ in range(40):
        body = " ".join(rnd.choice(words) + str(rnd.randint(0, 400)) for _ in range(rnd.randint(20, 120)))
        texts.append(body + ("\n" + shared if rnd.random() < 0.3 else "") + "\nCopyright line of all pages\n" + rnd.choice(words) * 3)
    texts += [texts[10]] * 6 + [texts[11] + " end", "y" * 5_000, " ".join(f"w{i}" for i in range(30_000))]
    rows = [(i, t, "en", rnd.choice(["a", "b", "ü", None]), len(t or ""), i, "k", 1, "l", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[13], None, None, None, None, None, None, None, None, None), (None, None, None, "a", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id", "text").persist()


@pytest.fixture(scope="module")
def documents(awkward):
    return [r.asDict() for r in awkward.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
