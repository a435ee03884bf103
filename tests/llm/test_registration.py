import re

import __spark_entry__


def test_each_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert {"op4_mix", "op9_host_rules"} <= __spark_entry__.oracle_sql().keys()
