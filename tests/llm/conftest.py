import random

import pytest

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))


def _texts() -> list:
    """Own prose: near copies, exact copies, junk, an empty, a blank, a null and a very long text."""
    rng = random.Random(5)
    words = ["lamp", "river", "Straße", "été", "niño", "copper", "under", "seven", "paper", "cloud", "stone", "winter", "bread", "garden"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 90))) for _ in range(40)]
    near = [b + " x" for b in base[:6]] + [b.replace("lamp", "lamp lamp", 1) for b in base[:6]]
    odd = ["", "   \n\t", None, "one", "two words", "A a. A a! \n\n A a.", "### $$$ ||| &&&", "ÀÉ\u00a0\u2003x\x1cy\x85z", LONG, LONG + " tail"]
    return base + near + base[:5] * 2 + odd


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with nulls, repeated rows, and further columns whose names clash with the operators' own."""
    langs, sources = ["en", "de", None], ["s1", "s2", None, "S2", "ä"]
    rows = [(i, t, langs[i % 3], sources[i % 7 % 5], i, f"extra{i}", i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id text with some words", None, "s1", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, n_words string, shard int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
