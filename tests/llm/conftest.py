import random

import pytest

from seriesloom.llm.common import ship_code

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_code(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and white texts, repeated rows, equal texts, one long text, odd characters."""
    rnd = random.Random(5)
    words = ["the", "of", "cat", "Dog", "maison", "été", "straße", "#1", "$$", "naïve", "x" * 90, "中文", "İ", "12345"]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    passage = " ".join(rnd.choice(words[:8]) for _ in range(60))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, None), (4, "one two", "en", None, 7),
            (None, "no id here, " + passage, "en", "b", 5), (5, long, "fr", "b", len(long)), (6, passage, "en", "a", 1), (6, passage, "en", "a", 1),
            (7, passage + " and an end", "en", "a", 1), (8, "é" * 70, "fr", "c", 70), (9, "è" + "é" * 69, "fr", "c", 70),
            (10, "<|endoftext|> is text\x85here too", "en", "c", 3), (11, "12 34 -- 56", "en", "d", 3)]
    rows += [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))), "en", rnd.choice("abcd"), 3) for i in range(20, 60)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
