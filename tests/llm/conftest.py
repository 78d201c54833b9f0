import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

TEXT_ROWS = [
    (1, "one two three four. " * 20 + "\nsame line here\nsame line here\n\n \n", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (4, " \t\n", "x"),
    (5, "it's a b a b a b a b ##$ <|endoftext|> ünï 😀 ▁▁ x", None),
    (5, "it's a b a b a b a b ##$ <|endoftext|> ünï 😀 ▁▁ x", None),
    (None, "no id here, but words.", "y"),
    (None, None, None),
    (7, "very long " * 8000, "z"),
    (8, "a" * 3000, "z"),
    (9, "<|startoftext|>foo <|endoftext|> bar. It's<|endoftext|>, Élan", "z"),
]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, repeated rows, a long text, and other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "w") for r in TEXT_ROWS], "doc_id long, text string, source string, size int, words string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
