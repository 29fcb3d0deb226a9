"""Queries over facts alone fold and keep nothing; expectations are matched without a join."""

import pytest

from deflow.operators.experiments import match_expected
from deflow.plans import QUERIES, language, programs

FACTS = ["program_arguments", "program_barriers", "program_call_edges", "program_control_flow", "program_facts", "program_flow_nodes",
         "program_parameter_types", "program_unique_names"]
FORMS = ["language_barriers", "language_flow_edges", "language_control_flow"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.range(60).selectExpr(
        "id AS l_orderkey", "cast(1 + id % 3 AS int) AS l_linenumber", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "id * 1.5D AS l_extendedprice",
        "cast(id AS double) AS l_quantity", "(id % 11) / 100D AS l_discount", "if(id % 2 = 0, 'F', 'O') AS l_linestatus",
        "element_at(array('A', 'N', 'R'), cast(id % 3 AS int) + 1) AS l_returnflag").write.parquet(f"{d}/lineitem.parquet")
    spark.range(len(language.FORMS) * 2).selectExpr("id AS o_orderkey").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", FACTS + FORMS)
def test_facts_need_no_analysis(spark, sf, name):
    programs.forget()
    straight = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
    assert straight and not programs._CACHE
    (programs.placed if name in FACTS else language.functions)(spark, sf)
    assert straight == sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=repr)
    programs.forget()


def test_matches_without_join(spark):
    expected = spark.createDataFrame(
        [(1, "a", "x", False), (1, "a", "x", False), (1, "b", "x", False), (1, None, "x", False), (2, "a", "x", True), (2, "b", "y", True),
         (3, "a", "x", False), (None, "a", "x", None), (None, "b", "x", None)], "case int, symbol string, kind string, dedup boolean")
    found = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, None, "x"), (2, "c", "x"), (4, "a", "x"), (None, "a", "x")], "case int, symbol string, kind string")
    m = match_expected(expected, found)
    assert {(r["case"], r["expected"], r["caught"]) for r in m.collect()} == {(1, 4, 2), (2, 2, 1), (3, 1, 0), (None, 2, 0)}
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString()
