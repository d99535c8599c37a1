from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """A table of documents out of texts or (id, text) pairs, with columns whose names may clash."""

    def make(rows, extra=False):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        frame = spark.createDataFrame(pairs, "doc_id long, text string")
        if extra:
            for name in ("id", "row", "node", "n", "pos", "kind", "ids", "score", "pii", "label"):
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make
