import pytest

from tabscout.operators import query
from tabscout.operators.query import QuerySpec, run
from tabscout.operators.chartdata import suggest_for_result


def test_filter_equals(employees):
    out = run(employees, {"filters": [{"column": "department", "operator": "==", "value": "IT"}]})
    assert out.count() == 2


def test_mean_of_group(employees):
    out = run(employees, {"groupby": ["department"], "aggregations": [{"column": "salary", "function": "mean"}],
                          "filters": [{"column": "department", "operator": "==", "value": "IT"}]})
    assert [tuple(r) for r in out.collect()] == [("IT", 77500.0)]
    assert out.columns == ["department", "mean_salary"]


def test_keys_in_reverse_order(employees):
    out = run(employees, {"groupby": ["department", "name"], "aggregations": [{"column": "id", "function": "count"}]})
    assert out.columns == ["name", "department", "count_id"]


def test_default_limit_and_bounds():
    assert QuerySpec().limit == 100
    for bad in (0, 201):
        with pytest.raises(ValueError):
            QuerySpec(limit=bad)


@pytest.mark.parametrize("part", [
    {"filters": [{"column": "salary", "operator": "between", "value": [1]}]},
    {"filters": [{"column": "salary", "operator": "in", "value": 3}]},
    {"filters": [{"column": "salary", "operator": "~", "value": 3}]},
    {"aggregations": [{"column": "salary", "function": "stddev"}]},
    {"select": ["nothing"]},
    {"sort": [{"column": "nothing"}]},
    {"having": []},
])
def test_bad_specs(employees, part):
    with pytest.raises(ValueError):
        run(employees, part)


def test_nulls_fail_every_predicate(gaps):
    def rows(op, value):
        return run(gaps, {"filters": [{"column": "department", "operator": op, "value": value}]}).count()
    assert rows("==", "IT") + rows("!=", "IT") == 9
    assert rows("in", []) == 0


def test_backslash_is_literal(spark):
    df = spark.createDataFrame([("a\\b",), ("a%b",), ("axb",)], "s string")
    found = run(df, {"filters": [{"column": "s", "operator": "like", "value": "a\\%"}]})
    assert [r.s for r in found.collect()] == ["a\\b"]


def test_nulls_sort_last_both_ways(gaps):
    for descending in (False, True):
        rows = run(gaps, {"select": ["age"], "sort": [{"column": "age", "descending": descending}]}).collect()
        assert [r.age for r in rows][-3:] == [None, None, None]


def test_null_group_key_and_count(gaps):
    rows = run(gaps, {"groupby": ["department"], "aggregations": [{"column": "department", "function": "count"}]}).collect()
    assert {r.department: r.count_department for r in rows}[None] == 0


def test_text_against_number(employees):
    assert run(employees, {"filters": [{"column": "salary", "operator": ">", "value": "70000"}]}).count() == 2
    with pytest.raises(Exception):
        run(employees, {"filters": [{"column": "salary", "operator": ">", "value": "many"}]}).collect()


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c d` int")
    out = run(df, {"select": ["c d", "a.b"], "filters": [{"column": "a.b", "operator": "==", "value": 1}]})
    assert [tuple(r) for r in out.collect()] == [(2, 1)]


def test_large_median_agrees(spark, employees, monkeypatch):
    from tabscout.plans import sizing
    df = spark.range(3000).selectExpr("id % 7 as g", "if(id % 3 = 0, 5.0D, cast(id as double)) as v", "if(id % 11 = 0, null, 'x') as h")
    spec = {"groupby": ["g", "h"], "aggregations": [{"column": "v", "function": "median"}, {"column": "v", "function": "sum"}], "limit": 200}
    monkeypatch.setattr(sizing, "SMALL_INPUT_BYTES", 0)
    spread = {tuple(r) for r in run(df, spec).collect()}
    monkeypatch.setattr(sizing, "SMALL_INPUT_BYTES", 1 << 40)
    assert spread == {tuple(r) for r in run(df, spec).collect()}
    monkeypatch.setattr(sizing, "SMALL_INPUT_BYTES", 0)
    assert run(employees, {"aggregations": [{"column": "salary", "function": "median"}]}).first()[0] == 67500.0


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = run(df, {"select": ["l_orderkey"], "filters": [{"column": "l_quantity", "operator": ">", "value": 49}]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_chart_for_result(spark, employees):
    totals = run(employees, {"groupby": ["department"], "aggregations": [{"column": "salary", "function": "sum"}]})
    assert suggest_for_result(totals)["type"] == "bar"
    assert suggest_for_result(employees.select("id", "salary"))["type"] == "scatter"
    assert suggest_for_result(employees.limit(0))["type"] == "table"
    dates = spark.createDataFrame([("1/31/2023", 5), ("Feb 2, 2023", 6)], "day string, n int")
    assert suggest_for_result(dates)["type"] == "line"
    days = spark.createDataFrame([("2023-01-01", 5), ("2023-01-02", 6)], "day string, n int")
    assert suggest_for_result(days) == {"type": "line", "x_axis": "day", "y_axis": "n", "reason": "Time series data detected"}


def test_approximate_distinct(employees):
    rows = query.distinct_count(employees, ["id", "department"], approximate=True).collect()
    assert {r.column: r.unique_count for r in rows} == {"id": 4, "department": 3}
