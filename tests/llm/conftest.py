import random

import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, size int, score double, ids array<int>, n string, a int, b int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, equal texts, a repeated row, rows of one doc_id, clashing extra columns."""
    random.seed(3)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(random.choices(words, k=n))
    base, long = say(120), say(20_000)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \n", "one", "two words", base, base, " ".join(near), base + " " + say(3), long, long + " end", say(80) + " " + base[:400], "ÄÖ é 中文 😀 <|endoftext|> <s> ▁", "x" * 5000, say(200), "the of and to", "a \n b  c"]
    rows = [(i, t, random.choice(["en", "de", None]), random.choice(["s1", "s2", None]), len(t) if t else None, "k", 1, 2, 0.5, [1], "n", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (14, say(50), "en", "s1", None, None, None, None, None, None, None, None, None), (None, say(60), None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
