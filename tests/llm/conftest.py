import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, q string, fp long, block string, word string, words string, score double, n_words long, first_id long"


def documents(spark, texts, ids=None, langs=None):
    """Documents with more columns, named like those that the operators make."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(d, t, langs[i] if langs else "en", None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), True, "x", 7, "b", None, "w", 0.5, 3, 1) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None, langs=None: documents(spark, texts, ids, langs)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, long and unusual texts."""
    rnd = random.Random(5)
    words = ["the", "and", "Straße", "naïve", "don't", "2024", "x", "日本", "a.b", "--", "é", "<|endoftext|>", "<|startoftext|>"]
    long = " ".join(rnd.choice(words) for _ in range(3000))
    same = "one two three four five " * 15
    return [None, "", " \t\n", "a", "Ab aB", same, same, same.upper(), long, long + " more", "line\nline\nline\n\n", "x" * 3000, "a a a a a", "#*$%&|<>", "\x1c\x1d 　x y", "👍🏽 é ﬁ"] + [
        "".join(rnd.choice("abcdeé \n.,'1#") for _ in range(rnd.randint(1, 300))) for _ in range(40)
    ]
