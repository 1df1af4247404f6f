import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from coursemill.llm.queries import prepare  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    """Make a documents table from ``(doc_id, text)`` rows; extra columns carry names that operators use inside."""

    def make(rows, lang="en"):
        full = [(i, t, lang if not isinstance(lang, dict) else lang.get(i), "s", None if t is None else len(t), -7, "x", -1, "y")
                for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", fp long, spans string, root long, line string")

    return make
