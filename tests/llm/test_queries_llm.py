"""The queries of the subpackage against SQL, and their coverage of whole tables."""

from pathlib import Path

import pytest
from compare import differences, oracle_rows

from murmurline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, tiny, name):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    assert differences(queries.QUERIES[name](spark, tiny), queries.ORACLES[name], tiny) == ""


def test_packs_hold_every_document(spark, tiny):
    if not Path(tiny).exists():
        pytest.skip("no test tables here")
    packed = queries.p8_packs(spark, tiny)
    got = {(r.pack_name, r.doc_id) for r in packed.select("pack_name", "doc_id").distinct().collect()}
    _, rows = oracle_rows("SELECT pack_name, doc_id FROM pack_capacities, documents WHERE text <> ''", tiny)
    assert got == set(rows)
