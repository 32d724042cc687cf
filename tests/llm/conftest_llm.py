"""Frames for the tests of this folder."""


def docs_frame(spark, rows):
    """(doc_id, text) rows as documents, with other columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", f"src{n % 3}", None if t is None else len(t), 7, "x", 1.5, [1]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key int, label string, score double, spans array<int>")
