"""Descriptions from files and collections to CSV folders."""

import json

from loomwork.operators.generate import Options, generate_file
from loomwork.sources import csv


def test_description_from_file_and_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("schema R { a: int in 1..3 } dataset A { rs: 4 of R }")
    assert generate_file(spark, str(tmp_path / "a.txt"), Options(1))["rs"].count() == 4
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "1.txt").write_text("schema R { a: 7 }\nschema Q {\n")
    (folder / "2.txt").write_text("b: 8 } dataset A { rs: 2 of R } dataset B { qs: 3 of Q }")
    frames = generate_file(spark, str(folder))
    assert {n: df.collect() for n, df in frames.items()} == {"rs": [(7,)] * 2, "qs": [(8,)] * 3}


def test_imports_beside_a_file(spark, tmp_path):
    (tmp_path / "api.json").write_text(json.dumps({"openapi": "3.0.0", "components": {"schemas": {"Pet": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 5, "maximum": 6}}}}}}))
    (tmp_path / "a.txt").write_text('import api from "api.json" schema Pet from api.Pet { x: n * 2 } dataset A { pets: 9 of Pet }')
    rows = generate_file(spark, str(tmp_path / "a.txt"))["pets"].collect()
    assert len(rows) == 9 and all(r.n in (5, 6) and r.x == 2 * r.n for r in rows)


def test_collections_to_csv_and_back(spark, tmp_path):
    frames = {"a": spark.createDataFrame([(1, 'x"y, z')], "i int, t string"), "b": spark.createDataFrame([], "j int")}
    at = csv.write_csvs(frames, f"{tmp_path}/out/", csv.Writing(delimiter=";"))
    assert set(at) == {"a", "b"} and at["a"].endswith("/out/a")
    assert csv.read_csv(spark, at["a"], csv.Reading(delimiter=";")).collect() == [(1, 'x"y, z')]
