from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with the given texts; doc_ids count from 0 unless pairs are given."""

    def make(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        lang, source = more.get("lang", ["en"] * len(rows)), more.get("source", ["s"] * len(rows))
        return spark.createDataFrame(
            [(i, t, a, b, len(t or ""), "x", 1) for (i, t), a, b in zip(rows, lang, source, strict=True)],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, start int",
        )

    return make
