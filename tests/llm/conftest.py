import pytest
from pyspark.sql import types as T

#: Documents with columns whose names operators use inside, and nulls in any column.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("copy", T.StringType()),
        T.StructField("mark", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("n_dropped", T.StringType()),
        T.StructField("hits", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of documents from (id, text) or (id, text, lang, source)."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "c", "m", "i", None, "h") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


#: Null, empty, blank, very long and repeated texts; ids that are null or repeated.
ODD = [
    (1, None), (2, ""), (3, "  \n\t\n"), (4, "one"), (5, "one"), (5, "one"), (5, "other text here"),
    (None, None), (None, "null id"), (None, "null id"), (6, "x" * 200_000), (7, "word " * 60_000),
    (8, "äöü ßéñ \U0001f600 " * 50), (9, "\n" * 1000),
]
