"""Registered questions on tables built here."""

import datetime

from greenledger.plans import relational  # noqa: F401  (registers the queries)
from greenledger.plans.registry import callables


def test_named_parameters_pass_each_metric_once(spark, tmp_path, capsys):
    """The readings are combined to their metrics where they are read, not sent or sorted one by one."""
    day = datetime.datetime(2022, 1, 1)
    tables = {
        "customer": ([(i, f"c{i}", 0, "AUTO") for i in range(3)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "nation": ([(0, "X")], "n_nationkey long, n_name string"),
        "supplier": ([(i, f"s{i}", 0) for i in range(5)], "s_suppkey long, s_name string, s_nationkey long"),
        "orders": ([(4 * i + 1, i % 3, "F", 100.0, day) for i in range(500)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = callables()["s3_named_parameters"](spark, str(tmp_path))
    assert [r.description for r in found.collect()] == ["Society"]
    found.explain()
    assert "HashAggregate(keys=[metric_id" in capsys.readouterr().out
