"""Every query against its SQL twin, and the independence of the core from the subpackage llm."""

from pathlib import Path

import pytest
from compare import differences

from murmurline.queries import panel, problems, stages, store

ROOT = Path(__file__).resolve().parents[1]
TWINS = {n: (m.QUERIES[n], sql) for m in (panel, store, stages, problems) for n, sql in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_agrees_with_sql(spark, tiny, name):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    query, sql = TWINS[name]
    assert differences(query(spark, tiny), sql, tiny) == ""


def test_core_does_not_import_llm():
    for path in (ROOT / "murmurline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "murmurline").parts:
            assert "murmurline.llm" not in path.read_text(), path
