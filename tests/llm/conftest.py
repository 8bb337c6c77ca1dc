import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(9000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seventy small birds watch from an old fence in silence"

# null and repeated ids, null, empty, blank and very long texts, repeated rows, near and exact copies
EDGE = [
    (1, f"First words here. {PASSAGE} and then an ending of its own."),
    (2, f"Another start. {PASSAGE} with other last words."),
    (3, f"Another start. {PASSAGE} with other last words."),
    (3, f"Another start. {PASSAGE} with other last words."),
    (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "two words"), (9, "one"),
    (None, f"First words here. {PASSAGE} and then an ending of its own."), (None, None), (None, "lonely text without an id that nobody else has"),
    (10, LONG), (11, LONG[:60_000] + " different end"), (12, "aaaa" * 200), (13, "aaaa" * 150), (14, "Größe çà 漢字 " * 12), (14, "same id, other text"),
    (15, f"Another start. {PASSAGE} with other last word."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with further columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", 1, "x", 2.0, "y") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, fp string, score double, _text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")


@pytest.fixture(scope="session")
def sample(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables are absent")
    return spark.read.parquet(f"{SF}/documents.parquet")
