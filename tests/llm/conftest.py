import pytest


@pytest.fixture
def documents(spark):
    """A small table with every awkward case: null and empty texts, ties, repeated rows, nulls, clashing column names."""
    words = "the quick brown fox jumps over the lazy dog and then some more words follow in this line here".split()
    long = " ".join(f"{w}{i}" for i in range(1500) for w in words[:3])
    rows = [
        (1, " ".join(words), "src0", "x"),
        (2, " ".join(words), "src0", "y"),
        (3, " ".join(words), None, "x"),
        (4, None, "src1", None),
        (5, "", "src1", "x"),
        (6, "one two", "src2", "x"),
        (7, "one two", "src2", "x"),
        (7, "one two", "src2", "x"),  # a repeated row
        (None, "a text without an id", "src2", "x"),
        (9, long, "src3", "x"),
        (10, long + " tail", "src3", "x"),
        (11, "  \n\t ", "src3", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")


@pytest.fixture
def nothing(documents):
    return documents.where("false")
