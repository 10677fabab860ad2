import random

import pytest
from pyspark import cloudpickle

from tarnwell.llm import common, embedding_dedup, fill_in_middle, language, license_scan, linear, mixing, mpeg_audio, ngram_join, packing, quality, suffix_dedup, toxicity, vector_codes

#: Names that operators use for their own columns or results.
EXTRA = ("cls", "grp", "_row", "_key", "score", "component_id", "_chance", "n", "root", "token", "start", "kept")


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    book = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    return " ".join(rng.choice(book) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, repeated rows, ids that repeat, ties, signs beyond ASCII, a long text."""
    a = prose(1, 120)
    near = a.split()
    near[60] = "other"
    return [
        (1, a), (2, a), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (None, a), (None, None), (7, "one"), (8, "one"), (9, "ONE two"),
        (10, "é ß ああ \U0001f600 <|endoftext|> don't it's 12 x²"), (11, prose(2, 3000)), (12, prose(2, 3000)[500:4000]), (13, "ab" * 400), (7, "an id twice"),
        (14, "x" * 5000), (15, prose(3, 40)), (-3, prose(3, 40) + " more"),
    ]


def table(spark, rows, extra: bool = True):
    """Documents with columns whose names clash with the operators' own."""
    names = EXTRA if extra else ()
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in names)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("?" for _ in names)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture
def patched(monkeypatch):
    """patched(module, NAME=value, ...): constants that hold in the workers too, which else import the modules anew."""
    modules = (common, embedding_dedup, fill_in_middle, language, license_scan, linear, mixing, mpeg_audio, ngram_join, packing, quality, suffix_dedup, toxicity, vector_codes)
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    yield lambda module, **values: [monkeypatch.setattr(module, k, v) for k, v in values.items()]
    for m in modules:
        cloudpickle.unregister_pickle_by_value(m)
