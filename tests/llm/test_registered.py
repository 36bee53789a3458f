"""The numbered queries are all there; a failed import would leave them out silently."""

import __spark_entry__ as entry


def test_numbered_queries():
    found = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert found == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert {"op2_mixture", "op6_quality_rules", "op11_exact_dedup", "op13_hard_negatives"} <= set(entry.oracle_sql())
