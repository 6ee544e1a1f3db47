"""Records that cross byte ranges, against readers that take a file whole."""

import csv
import json
import random

import pytest
from pyspark.sql import types as T

from tabscout.sources import files as f, records as rec

PARTS = ['"', ",", "\n", "\r\n", "{", "}", "[", "]", "\\", "a", "é", "word ", "日本", ":", " "]


@pytest.fixture(params=[150, 1 << 20])
def ranges(spark, request):
    """Byte ranges so short that most records cross one, some several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def texts(seed, n=40):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else "x" + "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 20, 120]))) for _ in range(n)]


def test_csv_with_line_breaks(spark, tmp_path, ranges):
    want = set()
    for i in range(2):
        with open(tmp_path / f"{i}.csv", "w", newline="", encoding="utf-8-sig" if i else "utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if i else "\n")
            w.writerow(["n", "text"])
            for j, t in enumerate(texts(i)):
                w.writerow([i * 1000 + j, t])
                want.add((i * 1000 + j, t))
    for schema in (T.StructType.fromDDL("n int, text string"), None):
        df = f.read_csv(spark, str(tmp_path), schema, line_breaks=True)
        assert df.dtypes == [("n", "int"), ("text", "string")]
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want


def test_csv_with_line_breaks_in_one_byte_sets(spark, tmp_path, ranges):
    for name, encoding, sign in (("w", "cp1252", "€"), ("l", "latin-1", "\x81")):
        rows = [(i, f"caf\xe9 {sign}\n\"{i}\"" * (i % 7 + 1)) for i in range(25)]
        with open(tmp_path / name, "w", newline="", encoding=encoding) as out:
            csv.writer(out).writerows([("n", "text"), *rows])
        assert sorted(tuple(r) for r in f.read_csv(spark, str(tmp_path / name), line_breaks=True).collect()) == rows


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, ranges, indent):
    rows = [{"n": i, "text": t, "deep": {"list": [{"k": t}, {"k": "}"}], "empty": {}}} for i, t in enumerate(texts(7))]
    (tmp_path / "a.json").write_text(json.dumps(rows[:35], indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n [" + json.dumps(rows[35:], indent=indent)[1:] + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    schema = T.StructType.fromDDL("n int, text string, deep struct<list: array<struct<k: string>>>")
    got = f.read_records(spark, str(tmp_path), schema=schema).orderBy("n").collect()
    assert [(r.n, r.text, [x.k for x in r.deep.list]) for r in got] == [(r["n"], r["text"], [x["k"] for x in r["deep"]["list"]]) for r in rows]
    assert f.read_records(spark, str(tmp_path)).count() == len(rows)


def test_odd_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert f.read_csv(spark, str(tmp_path / "h.csv"), line_breaks=True).count() == 0
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        f.read_csv(spark, str(tmp_path / "e.csv"), line_breaks=True)
    (tmp_path / "w.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        f.read_csv(spark, str(tmp_path / "w.csv"), line_breaks=True).collect()
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"a": 2')
    for name, text in (("broken", '[{"a": 1}, {"a": 2'), ("open", '[{"a": 1}, {"a": 2}'), ("after", '[{"a": 1}] {"a": 2}'), ("closed", '[{"a": 1}}]'), ("plain", "[1, 2]")):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception):
            f.read_records(spark, str(tmp_path / f"{name}.json"), schema=T.StructType.fromDDL("a int")).collect()


def test_states_too_many_to_send(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(rec, "RANGES", 0)
    rows = [{"n": i, "text": t} for i, t in enumerate(texts(3))]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = f.read_records(spark, str(tmp_path)).orderBy("n").collect()
    assert [(r.n, r.text) for r in got] == [(r["n"], r["text"]) for r in rows]


def test_whole_batches_are_never_python_values():
    """Rows of a large Arrow batch are turned into Python values a slice at a time."""
    import pyarrow as pa
    from tabscout.sources import records

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    slices = [b.column(0).to_pylist() for b in records.few_rows([batch, batch])]
    assert max(map(len, slices)) == records.SLICE and sum(slices, []) == [*range(1000)] * 2


@pytest.mark.parametrize("few_bytes", [True, False])
def test_files_that_are_consumed(spark, tmp_path, ranges, monkeypatch, few_bytes):
    """In rounds or at once: all rows of all files by the encoding of the whole folder, and nothing left of the files."""
    monkeypatch.setattr(rec, "ROUND_BYTES", 1 if few_bytes else 1 << 30)
    folder, want = tmp_path / "a folder", []
    folder.mkdir()
    for i in range(6):  # only one file shows that the set is ISO-8859-1
        rows = [(i * 100 + j, f"caf\xe9 {'\x81' if i == 5 else '\x85'}\n\"{j}\"") for j in range(9)]
        with open(folder / f"{i}.csv", "w", newline="", encoding="latin-1") as out:
            csv.writer(out).writerows([("n", "text"), *rows])
        want += rows
    df = f.read_csv(spark, str(folder), T.StructType.fromDDL("n int, text string"), line_breaks=True, consume=True)
    assert not folder.exists()
    assert sorted(tuple(r) for r in df.collect()) == want == sorted(tuple(r) for r in df.collect())


def test_files_of_every_encoding_are_not_kept(spark, tmp_path, monkeypatch):
    """What the query leaves is packed: less than one copy of the texts that it wrote four times."""
    import checks
    from checks import storage

    rng, made = random.Random(5), []
    monkeypatch.setattr(storage, "scratch_path", lambda s, label: made.append(str(tmp_path / label)) or made[-1])
    rows = [(i, "web", " ".join(rng.choice(["caf\xe9", "plain", 'a "word"', "line\nbreak"]) for _ in range(50))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = checks.QUERIES["src_csv_encodings"](spark, str(tmp_path))
    assert len(made) == 4 and not any((tmp_path / m).exists() for m in made)
    assert sorted((r.doc_id, r.source, r.text) for r in out.where("enc = 'windows'").collect()) == rows and out.count() == 1200
