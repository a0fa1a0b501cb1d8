import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from perigee.session import prepare  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, size string, f double"


@pytest.fixture(autouse=True)
def _shipped(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    """``documents(rows)``: a table of (doc_id, text[, source]) with extra columns whose names clash with inner ones."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, 3, "x", "y", 0.5) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build

