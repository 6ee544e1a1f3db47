import pytest
from pyspark.sql import functions as F

from tabscout.operators import audit as a, platform as pf, questions as nl
from tabscout.sources import files as f


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_history_pages(spark):
    history = spark.range(25).selectExpr("id", "'u' as user_id", "timestamp_seconds(id) as ts")
    mine = F.col("user_id") == "u"
    first = pf.history_page(history, mine, "ts", "id").collect()
    assert [r.id for r in first] == list(range(24, 4, -1)) and first[0].total_count == 25
    assert [r.id for r in pf.history_page(history, mine, "ts", "id", offset=20).collect()] == [4, 3, 2, 1, 0]
    assert pf.history_page(history, F.lit(False), "ts", "id").count() == 0
    assert pf.page(spark.range(100), [F.col("id")], limit=80).count() == 50


def test_best_row_puts_nulls_last(spark):
    rows = spark.createDataFrame([("d", 1, None, 0.9), ("d", 2, 0.5, 0.1), ("d", 3, 0.5, 0.3), ("e", 4, None, 0.2)], "d string, id int, cv double, t double")
    assert {r.d: r.id for r in pf.best_per_key(rows, "d", ["cv", "t"], "id").collect()} == {"d": 3, "e": 4}


def test_audit_of_platform_tables(spark):
    rules = a.platform_rules()
    assert len({r.name for r in rules}) == len(rules)
    users = spark.createDataFrame([("1", "a@b.co", "user"), ("2", "nope", "boss"), ("3", None, None), ("3", "a@b.co", "admin")], "id string, email string, role string")
    mine = [r for r in rules if r.table == "users" and r.name in (
        "users.role in list", "users.email pattern", "users.email not null", "users.id unique", "users.email unique", "users.role not null")]
    got = {r.rule: r.violations for r in a.audit({"users": users}, mine).collect()}
    assert got == {"users.role in list": 1, "users.email pattern": 1, "users.email not null": 1, "users.role not null": 1, "users.id unique": 1, "users.email unique": 1}


def test_stored_insight_types_break_the_list(spark):
    insights = spark.createDataFrame([("statistical",), ("patterns",), ("trend",)], "insight_type string")
    rule = a.one_of("insights", "insight_type", a.INSIGHT_TYPES)
    assert a.audit({"insights": insights}, [rule]).first().violations == 2


def test_question_words_follow_letters(spark):
    q = spark.createDataFrame([("étop sales",), ("top 999 sales",), ("count\nby region",), ("count them by region",), ("top " + "9" * 30,), ("",)], "question string")
    rows = nl.route(q, [("sales", "numeric"), ("region", "categorical")]).collect()
    by = {r.question: r for r in rows}
    assert by["étop sales"].pattern == "default" and by["top 999 sales"].query.limit == 200
    assert by["count\nby region"].pattern == "default" and by["count them by region"].pattern == "count"
    assert by["top " + "9" * 30].query.limit == 200 and by[""].query.limit == 10


def test_ask(employees, spark, folder):
    answer = nl.ask(employees, "What is this about?")
    assert answer["intent"] == "conversational" and "**4 rows**" in answer["text_response"] and answer["result"] is None
    answer = nl.ask(employees, "average salary by department")
    assert {r.department: r.avg_salary for r in answer["result"].collect()}["IT"] == 77500.0 and answer["chart"]["type"] == "bar"
    row = nl.history_row(answer, spark, "u", "d").first()
    assert row.was_successful and "77500" in row.result_preview
    for _ in range(2):
        nl.append_history(nl.history_row(answer, spark, "u", "d"), folder + "/history")
    assert spark.read.parquet(folder + "/history").count() == 2
    assert "rows are empty" in nl.ask(employees.withColumn("salary", F.when(F.col("id") > 1, F.col("salary"))), "suggest how to clean it")["text_response"]


def test_csv_encodings(spark, folder):
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "latin-1")):
        with open(f"{folder}/{name}.csv", "w", encoding=encoding) as out:
            out.write("name,n\ncafé,1\nnaïve,2\n")
        df = f.read_csv(spark, f"{folder}/{name}.csv")
        assert df.columns == ["name", "n"] and [tuple(r) for r in df.orderBy("n").collect()] == [("café", 1), ("naïve", 2)]
    open(f"{folder}/empty.csv", "w").close()
    with pytest.raises(ValueError):
        f.read_csv(spark, f"{folder}/empty.csv")
    with open(f"{folder}/bad.csv", "w") as out:
        out.write("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        f.read_csv(spark, f"{folder}/bad.csv", schema=None).collect()


def test_records_and_datasets(spark, folder):
    with open(f"{folder}/r.json", "w") as out:
        out.write('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert f.read_records(spark, f"{folder}/r.json").count() == 2
    assert f.read_records(spark, None).count() == 0
    df = spark.range(10).selectExpr("id as col1", "id * 2 as col2")
    f.save_dataset(df, folder, "x/../y")
    assert sorted(map(tuple, f.load_dataset(spark, folder, "x/../y").collect())) == [(i, 2 * i) for i in range(10)]
    with pytest.raises(LookupError):
        f.load_dataset(spark, folder, "other")
    f.save_dataset(df.limit(0), folder, "none")
    with pytest.raises(ValueError):
        f.load_dataset(spark, folder, "none")


def test_sanitize(spark):
    df = spark.sql("select double('NaN') as a, double('Infinity') as b, 1.5D as c, timestamp_ntz'2024-01-02 03:04:05.678' as t, cast(null as timestamp) as u")
    assert tuple(f.sanitize(df).first()) == (None, None, 1.5, "2024-01-02 03:04:05", None)


def test_validate(spark):
    rules = lambda *args, **kw: {r.rule for r in f.validate(*args, **kw).collect()}
    df = spark.range(3)
    assert rules(df, "a.csv") == set()
    assert rules(df, "a.txt", 200, max_bytes=100, min_rows=10, min_columns=2) == {"file type", "file size", "too few rows", "too few columns"}
    assert rules(df, max_rows=2, max_columns=0) == {"too many rows", "too many columns"}


def test_csv_in_one_byte_sets(spark, folder):
    """windows-1252 where all bytes are defined in it, else ISO-8859-1; header names are decoded as well."""
    from tabscout.sources.files import read_csv

    with open(f"{folder}/w.csv", "wb") as out:
        out.write("id,prix €\n1,“déjà” – 5 €\n2,œuf\n".encode("cp1252"))
    with open(f"{folder}/l.csv", "wb") as out:
        out.write(b"id,t\n1,caf\xe9 \x81 \x80\n")
    windows = read_csv(spark, f"{folder}/w.csv")
    assert windows.columns == ["id", "prix €"] and [tuple(r) for r in windows.collect()] == [(1, "“déjà” – 5 €"), (2, "œuf")]
    assert [tuple(r) for r in read_csv(spark, f"{folder}/l.csv").collect()] == [(1, "café \x81 \x80")]
