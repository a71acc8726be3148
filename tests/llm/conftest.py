import pytest
from samples import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside or return.
CLASHES = ("id", "row", "digest", "score", "kept", "held_out", "lang_pred", "rejected", "key", "doc", "n", "t", "words", "symbols",
           "start", "end", "item", "spans", "first", "copies", "size", "length", "rank", "part", "_text", "_id", "_key", "train")


@pytest.fixture(scope="session")
def make(spark):
    """A frame of documents with extra columns whose names clash."""

    def frame(rows, schema=DOCS, clash=True):
        df = spark.createDataFrame(rows, schema)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])
        return df

    return frame


@pytest.fixture(scope="session")
def odd_rows():
    """Null columns, empty and long texts, repeated rows, copies, an id with two texts."""
    a, b = prose(1, 120), prose(2, 90)
    texts = [(1, a), (1, a), (1, b), (2, a), (3, None), (None, None), (4, ""), (5, " \n\t"), (None, b), (6, prose(3, 60_000)),
             (7, "one"), (8, "1234 %% !!"), (9, "one"), (10, "ﬁn ß İ   漢字 \U0001f600 é" * 3)]
    return [(i, t, None if i == 2 else "xx", None, None) for i, t in texts]
