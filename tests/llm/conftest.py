import pytest
from pyspark.sql import types as T

from spendlens.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score string, _k1 string, spans int, size int, text_crc32 int, gram long"


def make(spark, rows):
    """Documents with the columns of the tables, and more whose names operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", "y", 2, 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
EDGES = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "One"), (4, "a b c d e f g h i j k l m n o p"), (4, "a b c d e f g h i j k l m n o p"),
    (5, "a b c d e f g h i j k l m n o p"), (None, "no id at all but some words to look at, fine"), (None, None), (6, LONG), (7, LONG + " end"),
    (8, "É ßı \U0001f600 \x0b\x0c\r\n\n\nx"), (9, "x" * 100_000), (10, "x " * 3000), (11, "\n" * 200), (12, "a\x00b \x00"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))


@pytest.fixture(scope="session")
def small(spark):
    return read_table(spark, "/root/testdata/sf0.001", "documents")
