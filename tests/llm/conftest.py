import pytest
from pyspark.sql import types as T

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, kind int, label int"


@pytest.fixture
def frame(spark):
    """Documents from texts (doc_id is the position) or from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2) for i, t in rows]
        return spark.createDataFrame(full, T._parse_datatype_string(WIDE))

    return make
