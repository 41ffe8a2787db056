import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(*rows, extra=False):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, "en", "src0")[:4] if len(row) == 2 else (*row, "src0")[:4] if len(row) == 3 else row
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names the operators use themselves
            for name in ("size", "rate", "seed", "copies", "n", "part_", "length", "piece", "kept", "component", "id", "band", "key", "spans_", "base_", "n_words", "row_", "shard", "slot", "position", "before"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
