"""Small tables of awkward documents."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string"


def docs(spark, texts, source="a"):
    rows = [(k, t, "en", source, len(t or ""), "r", "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)
