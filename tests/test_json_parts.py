import json
import random

import pytest

from loomwork.operators import running
from loomwork.sources import json_parts, ndjson


def save(tmp_path, data, **how):
    at = tmp_path / "data.json"
    at.write_text(json.dumps(data, **how))
    return str(at)


def odd_value(rng, depth=0):
    kinds = [lambda: rng.randrange(99), lambda: None, lambda: rng.choice(['a "quoted" {b}', "}{", "\\", "\\\\\"", "[,]", "ü}", '"a": [', "", "tail\\\""]), lambda: rng.random() < 0.5]
    if depth < 2:
        kinds += [lambda: {"k}": odd_value(rng, depth + 1), "l": 1}, lambda: [odd_value(rng, depth + 1) for _ in range(rng.randrange(3))], dict, list]
    return rng.choice(kinds)()


@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_elements_equal_those_of_the_parser(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(running, "CHUNK", 13)
    rng = random.Random(7)
    data = {n: [{"id": i, "v": odd_value(rng), "w": odd_value(rng)} for i in range(c)] for n, c in (("orders", 40), ("none", 0), ('odd "name" {', 25), ("last", 1), ("empty", 0))}
    at = save(tmp_path, data, **how)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        cut = json_parts.pieces(spark, at)
        assert cut.count() == (tmp_path / "data.json").read_text().count("}")
        assert spark.read.option("lineSep", "}").text(at).rdd.getNumPartitions() > 1
        got = [json.loads(r.body) for r in json_parts.elements(cut, cut.count()).orderBy("at").collect() if r.body]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [x for rows in data.values() for x in rows]


def test_collections(spark, tmp_path):
    data = {"a": [{"x": i, "s": "}" * (i % 3)} for i in range(30)], "b": [], "c": [{"y": 1.5, "in": {"z": [1, {"q": 2}]}}, {"y": 2}]}
    for how in ({}, {"indent": 1}):
        got = ndjson.read_json(spark, save(tmp_path, data, **how))
        assert list(got) == ["a", "b", "c"] and got["b"].count() == 0
        assert sorted((r.x, r.s) for r in got["a"].collect()) == [(r["x"], r["s"]) for r in data["a"]] and {r.y for r in got["c"].collect()} == {1.5, 2.0}


def test_other_files(spark, tmp_path):
    got = ndjson.read_json(spark, save(tmp_path, {"xs": [1, 2, 3], "rows": [{"a": 1}]}))
    assert got["xs"].count() == 3 and got["rows"].count() == 1
    assert ndjson.read_json(spark, save(tmp_path, {})) == {}
    assert {n: d.count() for n, d in ndjson.read_json(spark, save(tmp_path, {"a": [], "b": []})).items()} == {"a": 0, "b": 0}


def test_documents_in_files_that_tasks_wrote_side_by_side(spark, tmp_path):
    """Put together the files are the document; no task writes it whole; equal rows stay as many; arrays may be empty."""
    rows = [{"x": i % 40, "s": '} "' * (i % 3) + "ü{"} for i in range(200)] + [{"x": 0, "s": "ü{"}] * 3
    many = spark.createDataFrame([(r["x"], r["s"]) for r in rows], "x int, s string").repartition(4)
    one = spark.createDataFrame([(1.5,)], "y double")
    at = tmp_path / "doc"
    ndjson.write_document({"none": one.limit(0), "many": many, 'odd "{': one, "last": many.limit(0)}, str(at))
    files = sorted(f for f in at.rglob("part-*") if f.stat().st_size)
    data = json.loads("".join(f.read_text() for f in files))
    order = lambda x: sorted((r["x"], r["s"]) for r in x)
    assert list(data) == ["none", "many", 'odd "{', "last"] and order(data["many"]) == order(rows) and data['odd "{'] == [{"y": 1.5}] and data["last"] == data["none"] == []
    assert len(files) > 5 and max(f.read_text().count('"x"') for f in files) < 150
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = ndjson.read_json(spark, str(at), joined=True)
        assert list(got) == list(data) and sorted((r.x, r.s) for r in got["many"].collect()) == order(rows)
        assert [r.y for r in got['odd "{'].collect()] == [1.5] and got["none"].count() == got["last"].count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files[1].write_text(files[1].read_text() + " ")
    (files[1].parent / f".{files[1].name}.crc").unlink()
    with pytest.raises(ValueError, match="brace"):
        ndjson.read_json(spark, str(at), joined=True)


def test_reading_keeps_less_than_the_document(spark, tmp_path, monkeypatch):
    """What is written between the steps is packed, and no copy of the document is kept."""
    numbers = iter(range(99))
    monkeypatch.setattr(json_parts, "folder", lambda spark, name: str(tmp_path / "shared" / str(next(numbers))))
    rows = spark.range(0, 20_000, 1, 2).selectExpr("id AS x", "concat('} \"', id % 7, '\" {') AS s")
    ndjson.write_document({"rows": rows}, str(tmp_path / "doc"))
    got = ndjson.read_json(spark, str(tmp_path / "doc"), joined=True)["rows"]
    assert got.count() == 20_000 and got.exceptAll(rows.selectExpr("s", "x")).count() == 0
    size = lambda at: sum(f.stat().st_size for f in at.rglob("part-*"))
    assert 0 < size(tmp_path / "shared") < size(tmp_path / "doc")


def test_elements_over_many_splits(spark, tmp_path):
    """Elements of several splits, which begin in strings, and end with other elements or alone."""
    data = {"a": [{"s": '}{\\"' * 400, "in": [{"z": "}" * 300}]}, {"s": "b", "in": []}, {"s": "[" * 900, "in": []}], "none": [], "c": [{"q": i} for i in range(40)], "d": [{"w": '"{' * 500}]}
    at = save(tmp_path, data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cut = json_parts.pieces(spark, at)
        rows = json_parts.elements(cut).orderBy("at").collect()
        assert [json.loads(r.body) for r in rows if r.body] == [x for xs in data.values() for x in xs]
        assert [r.head.strip() for r in rows] == ['"a": [', ",", ",", '], "none": [], "c": [', *[","] * 39, '], "d": [', "]}"]
        with pytest.raises(ValueError, match="pieces"):
            json_parts.elements(cut, cut.count() + 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
