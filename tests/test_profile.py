import math

from tabscout.operators import profile as p
from tabscout.operators.profile import Profile


def by_name(df, key="name"):
    return {r[key]: r for r in df.collect()}


def test_missing_values(gaps):
    prof = Profile(gaps)
    cols = by_name(prof.columns)
    assert [cols[c].missing_count for c in ("age", "salary", "department")] == [3, 2, 1]
    assert prof.quality.first().quality_score == 100 - 6 / 50 * 100
    issues = {(r.column, r.severity) for r in prof.quality_issues.collect()}
    assert issues == {("age", "medium"), ("salary", "medium")}
    assert {r.category for r in prof.recommendations.collect()} >= {"sample_size"}


def test_ranking_table(ranking):
    prof = Profile(ranking)
    pairs = {(r.column1, r.column2): r for r in prof.correlations().collect()}
    assert math.isclose(pairs["value_a", "value_b"].correlation, 1.0) and pairs["value_a", "value_b"].strength == "strong"
    outliers = by_name(prof.outliers, "column")
    assert outliers["outlier_col"].outlier_count == 1
    assert by_name(prof.columns)["missing_col"].missing_count == 7


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string, c timestamp")
    prof = Profile(df)
    assert prof.basic.first().asDict() == {"total_rows": 0, "total_columns": 3, "duplicate_rows": 0, "duplicate_percentage": None}
    assert [r.total_rows for r in prof.columns.collect()] == [0, 0, 0]
    assert prof.quality.first().quality_score is None
    assert prof.numeric_stats.count() == prof.datetime_stats.count() == prof.outliers.count() == 0


def test_one_row_constant_null_bool_and_nan(spark):
    df = spark.createDataFrame([(1, None, True, float("nan"), "x")], "a long, b double, c boolean, d double, e string")
    prof = Profile(df)
    cols = by_name(prof.columns)
    assert cols["c"].column_type == "categorical" and cols["d"].missing_count == 1 and cols["b"].unique_count == 0
    stats = by_name(prof.numeric_stats, "column")
    assert set(stats) == {"a"} and stats["a"].median == 1.0 and stats["a"].std is None and stats["a"].skewness is None
    assert prof.correlations().count() == 0


def test_constant_column_has_no_correlation(spark):
    df = spark.range(50).selectExpr("id as a", "0.1D as b", "id * 2 as c")
    found = {(r.column1, r.column2) for r in p.pair_correlations(df, ["a", "b", "c"]).collect()}
    assert found == {("a", "c")}


def test_pairwise_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 9.0), (4.0, 4.0)], "a double, b double")
    want = df.toPandas().corr().iloc[0, 1]
    assert math.isclose(p.pair_correlations(df, ["a", "b"]).first().correlation, want)


def test_duplicates_count_nulls_and_long_text(spark):
    long = "z" * 500
    df = spark.createDataFrame([(None, long, 0.0), (None, long, -0.0), ("a", long + "y", 1.0), ("a", long, 1.0)], "a string, b string, c double")
    assert p.duplicates(df).first().duplicate_rows == 1


def test_map_and_array_columns(spark):
    df = spark.sql("select map('k', 1) as m, array(1, 2) as a from range(3)")
    assert p.duplicates(df).first().duplicate_rows == 2
    assert {r.column: r.unique_count for r in p.distinct_counts(df).collect()} == {"m": 1, "a": 1}


def test_hot_value_ties_and_top(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id % 500)) as s")
    top = [(r["rank"], r["value"]) for r in Profile(df).top_values().orderBy("rank").collect()]
    assert top[0] == (1, "hot") and len(top) == 5
    plan = p.rank_frequencies(p.compact_frequencies(df, ["s"]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_texts_come_back_whole(spark):
    df = spark.range(30).selectExpr("repeat(concat('t', id % 4), 100) as s", "if(id < 2, null, concat('u', id % 3)) as u")
    top = {(r.column, r["rank"]): (r.value, r.cnt) for r in p.top_values(df, ["s", "u"], 2).collect()}
    assert {v for (c, _), v in top.items() if c == "s"} == {("t0" * 100, 8), ("t1" * 100, 8)}
    assert top["u", 1] == ("u2", 10)


def test_wide_table_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(p, "COLUMNS_PER_PASS", 3)
    df = spark.range(20).selectExpr(*[f"id * {i + 1} + pmod(xxhash64(id, {i}), 7) as c{i}" for i in range(8)])
    want = df.toPandas().corr()
    rows = p.pair_correlations(df, df.columns).collect()
    assert len(rows) == 28
    assert all(math.isclose(r.correlation, want.loc[r.column1, r.column2], rel_tol=1e-9) for r in rows)
    assert Profile(df).numeric_stats.count() == 8


def test_ties_of_texts_that_begin_alike_are_refined(spark):
    """Thousands of texts with one beginning: a few k of them are kept, and the smallest win."""
    df = spark.range(6000).selectExpr("concat(repeat('same beginning ', 20), lpad(cast(pmod(id * 7919, 3000) as string), 6, '0')) as s", "concat('x', id % 3) as u")
    freq = p.compact_frequencies(df, ["s", "u"])
    kept = p.refined(df, ["s", "u"], p.durable(p.rank_frequencies(freq, 5)), 5)
    assert kept.where("__c = 0").count() == 5
    got = [r.value for r in p.top_values(df, ["s", "u"], 5).where("column = 's'").orderBy("rank").collect()]
    assert got == ["same beginning " * 20 + f"{i:06d}" for i in range(5)]
    short = spark.range(100).selectExpr("if(id % 2 = 0, repeat('a', 64), repeat('a', 64 + id)) as s")
    found = [(r["rank"], len(r.value)) for r in p.top_values(short, ["s"], 3).orderBy("rank").collect()]
    assert found == [(1, 64), (2, 65), (3, 67)]
