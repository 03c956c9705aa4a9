import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from rows of (doc_id, text, lang, source)."""

    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(data, schema)
        if extra:  # names that operators use for their own columns
            for c in ("size", "kept", "component_id", "fp", "key", "spans", "blob", "id", "body", "row", "n", "target"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
