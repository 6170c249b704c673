import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def real(spark):
    """All documents of the smallest scale."""
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    text = "One two three four five six seven.\nAnother line of text stands here.\nOne two three four five six seven."
    return [
        (1, None, "en", "a"), (2, "", None, "b"), (None, "no id here at all, none", "en", None), (4, LONG, "en", "d"), (5, text, "de", "e"),
        (5, text, "de", "e"), (6, text, None, None), (7, " \n\t ", "xx", "g"), (8, "日本語 🙂 ümlaut É", "fr", "h"), (9, "!!! 123 ###", "en", "i"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    for name in ("key", "id", "block", "helper", "rank", "removed", "n_lines", "body", "base", "line", "bands", "length", "n", "root", "held_out"):
        frame = frame.withColumn(name, F.lit(f"x{name}"))
    return frame.withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
