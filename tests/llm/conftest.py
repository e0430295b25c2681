import pytest
from pyspark.sql import functions as F

#: Texts that every operator has to take: null, empty, blank, one word, ties, non-ASCII, one very long line.
ODD = [None, "", " \n\t ", "word", "word", "Ünïcodé 日本 \U0001f600", "a b c d e f g h " * 4000, "x" * 300_000, "<|endoftext|> \\ </s>[INST]"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null doc_id, a repeated row, and columns whose names operators use for themselves."""
    rows = [(k, t, "en" if k % 2 else None) for k, t in enumerate(ODD)]
    rows += [(None, "no id here at all", "en"), (3, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = {"kept": F.lit("mine"), "n_lines": F.lit(1), "gone": F.lit("g"), "d": F.lit(2), "line": F.lit("l"), "n": F.lit(3), "rep": F.lit("r"), "items": F.lit("i"), "spans": F.lit("s"), "grade": F.lit("q"), "row": F.lit(7), "n_chars": F.length("text").cast("long")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
