import pytest


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text[, lang, source]) rows, with columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), 7, "x", 1.5, None) for r in rows]
        return spark.createDataFrame(full, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size INT, node STRING, "
                                           "score DOUBLE, _gone STRING").repartition(3)
    return make
