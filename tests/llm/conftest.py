from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from awkward import AWKWARD, SCHEMA  # noqa: E402

@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns named like the operators' own, one twice but for case, before and after those they read."""
    rows = [(i, "KEY", d, 0.5, t, "n", lang, "x") for i, (d, t, lang, _) in enumerate(AWKWARD)]
    names = ["line", "key", "doc_id", "score", "text", "n_tokens", "lang", "Text"]
    return spark.createDataFrame(rows, "a long, b string, c long, d double, e string, f string, g string, h string").toDF(*names)
