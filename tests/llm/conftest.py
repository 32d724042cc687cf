import pytest
from conftest_llm import docs_frame


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and rows that repeat as a whole."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (4, "two words"), (None, "no id here"), (None, None), (5, long), (6, "é ß 漢字 🙂 ok 🙂"), (7, "a" * 5000), (-3, "negative id of a text that goes on for some words"), (8, "one")]
    frame = docs_frame(spark, rows)
    blank = spark.createDataFrame([(None,) * len(frame.columns)], frame.schema)
    return frame.unionByName(blank).cache()
