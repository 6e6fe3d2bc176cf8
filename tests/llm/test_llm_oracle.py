from __future__ import annotations

import importlib.util

import pytest
from oracle import SF, connection, same

from tramline.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, name):
    same(Q.QUERIES[name](spark, SF), Q.ORACLE_SQL[name], connection())


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("tramline").origin).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tramline.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
