import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
# Names that the operators use inside, or return.
CLASHING = ("id", "size", "shard", "slot", "score", "key", "band", "n", "words", "pos", "line", "h", "drop", "n_words", "taken", "item",
            "__id", "__text", "__k1", "__h", "__source", "__size", "a", "b", "c", "g", "first", "last", "runs", "text_key", "kept", "spans")

LINE = "this line is shared by many documents, word for word"
PROSE = " ".join(f"w{i * 7919 % 613}x{i % 17}" for i in range(420))
LONG = " ".join(f"v{i * 104729 % 9973}" for i in range(60_000))

#: (doc_id, text, source)
EDGE = [
    (1, None, "b"), (2, "", "a"), (3, " \t\n ", None), (4, PROSE, "a"), (5, PROSE + " and one more", "b"), (6, PROSE.upper(), None),
    (7, "MIT License", "c"), (8, "under the MIT license, MIT License; GNU General\nPublic  License", "c"), (9, "Ünïcode MİT licenſe KK apache license", ""),
    (10, LINE.upper() + "\nown ten\n" + LINE, "a"), (11, "  " + LINE + "\t", "a"), (12, LINE + "\r\nown twelve", "b"), (13, LINE, "b"), (14, LINE + "\n", None),
    (15, LONG, "a"), (16, "xx " + LONG, "b"), (17, "z" * 3000, "a"), (18, "ab" * 1500, "a"), (19, "one two three one two three one two", "a"),
    (20, "#*$ %&| <> plain\nplain\nplain\n\n \n", "b"), (None, "null id " + PROSE[:900], "a"), (None, PROSE, "b"), (21, "퟿\U0001f600 " * 300, "d"),
]
#: Rows that share an id, and a row twice.
REPEATED = [*EDGE, (4, PROSE, "a"), (7, "another text under id seven", "a"), (7, "MIT License", "c")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE).cache()


@pytest.fixture(scope="session")
def repeated(spark):
    return frame(spark, REPEATED).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    """(DataFrame, list of (doc_id, text, source)) of the smallest documents table."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, [(r["doc_id"], r["text"], r["source"]) for r in df.orderBy("doc_id").collect()]


def rows_of(df, *columns):
    """Rows as tuples, in an order that nulls do not upset."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
