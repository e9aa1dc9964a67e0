import os
import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text) rows."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def small(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


#: Rows that every operator must survive: null id, null and empty texts, repeated rows, odd bytes, long words.
ODD = [(None, "some text without an id"), (None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "é 漢字 \U0001f600 \x00 ünï"), (6, "x" * 5000), (7, "a b c d e f g h i j"), (8, "a b c d e f g h i j")]
