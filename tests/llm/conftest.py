import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import ODD  # noqa: E402

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts twice each, with columns whose names the operators use inside."""
    rows = [(n, t, [None, "en", "fr"][n % 3], [None, "a", "b", "é"][n % 4], n) for n, t in enumerate(ODD + ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for name in ("digest", "doc", "_maybe", "place", "id", "comp", "bucket", "group", "copies", "_key"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
