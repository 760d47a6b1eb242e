"""Small frames of documents with columns whose names clash."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, topic_ string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s0")), len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))
