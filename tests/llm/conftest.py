import os

import pytest

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def root():
    return ROOT


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) or (doc_id, text, lang, source) as a documents table."""

    def make(*rows, extra=""):
        full = [(r + (None, "s"))[:2] + (r[2:] if len(r) > 2 else ("en", "s")) + (None,) for r in rows]
        if extra:
            return spark.createDataFrame([r + ("x",) for r in full], f"{SCHEMA}, {extra} string")
        return spark.createDataFrame(full, SCHEMA)

    return make
