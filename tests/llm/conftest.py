import pytest

CLASHING = ["spans", "h", "_hash", "_text", "_i", "_h", "number", "text_hash", "label", "_kept_id", "_own_hash", "_leak_id", "places"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture()
def docs_of(spark):
    """Documents of (doc_id, text), with further columns whose names clash with the operators' own."""

    def make(rows, parts=2):
        full = [(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make
