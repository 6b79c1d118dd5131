from __future__ import annotations

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("the tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, s int, words string, t string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    same = "one two three four five six seven eight nine ten " * 3
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " more"), (8, "x"), (None, same), (None, None), (9, "é" * 40 + same), (-5, same + "tail words here")]
    return spark.createDataFrame([(i, t, None, None if k % 2 else "h", None if k % 3 else 7, None, "z", 1, None, "t", 0.5) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
