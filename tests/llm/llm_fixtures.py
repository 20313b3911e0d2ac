import pytest
from pyspark.sql import functions as F

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

# Rows every operator must take: NULLs in any column, empty and long texts, ties, repeated rows, a column that
# is called like one of the operators' own.
LONG = "the quick brown fox, l'été déjà; mail me at a.b@c-d.org or +1 (555) 010-2030. " * 400
EDGE = [
    (1, None, "en", "s", 1.0), (2, "", None, None, None), (3, " \t\n", "en", "s", 0.0), (4, "same text here", "en", "s", 1.0),
    (4, "same text here", "en", "s", 1.0), (5, "same  text\there", "fr", "t", 2.0), (6, LONG, "fr", "t", None),
    (None, "no id at all", "en", None, 3.0), (7, "ÀÉ 你好 \U0001f600 <|endoftext|> x", "fr", "s", 4.0), (8, "9" * 5000, None, "s", 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double"
EXTRA = ["row", "ids", "predicted", "candidates", "chunk", "fp", "length", "rank", "spans", "a.b", "c`d"]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("other"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (2, 0, 0), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")
