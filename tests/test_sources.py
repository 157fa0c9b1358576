import json

from pyspark.sql import functions as F

from loomwork.plans.syntax import parse
from loomwork.sources import csv, ndjson, openapi


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,ok,x,z\n1, "a ""q"", b" ,yes,1.5,\n\n2,"two\nlines",no,2.0,null\n3,c\n')
    df = csv.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "ok": "boolean", "x": "double", "z": "string"}
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got[1] == (2, "two\nlines", False, 2.0, None) and got[2] == (3, "c", None, None, None) and got[0][1].startswith('a "q"')
    bare = csv.read_csv(spark, str(path), csv.Reading(header=False, infer=False))
    assert bare.columns[0] == "column_1"


def test_flatten(spark):
    df = spark.sql("select named_struct('y', 1, 'x', array(3, 4)) b, 'q,\"r' a, cast(null as int) c")
    flat = csv.flattened(df, csv.Writing(arrays="first", null="-"))
    assert flat.columns == ["a", "b.x", "b.y", "c"] and tuple(flat.first()) == ('q,"r', "3", "1", "-")
    assert csv.lines(df.select("a")).first()[0] == '"q,""r"'


def test_sections(spark, tmp_path):
    csv.write_sections({"a": spark.range(2), "none": spark.range(0)}, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text() == "# a\nid\n0\n1\n"


def test_ndjson(spark, tmp_path):
    frames = {"a": spark.range(2), "b": spark.range(3).select((F.col("id") * 2).alias("v"))}
    for i, how in enumerate(({"include": True}, {"prefix": True})):
        ndjson.write_ndjson(frames, str(tmp_path / f"o{i}"), **how)
        back = ndjson.read_collections(spark, str(tmp_path / f"o{i}"), {"a": "id long", "b": "v long"})
        assert back["a"].count() == 2 and sorted(r[0] for r in back["b"].collect()) == [0, 2, 4]
    (tmp_path / "j.json").write_text(json.dumps({"xs": [{"a": 1}, {"a": 2}], "n": 3}))
    assert ndjson.read_json(spark, str(tmp_path / "j.json"))["xs"].count() == 2


def test_openapi(spark):
    document = {
        "components": {"schemas": {"Pet": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 1, "maximum": 5}, "kind": {"enum": ["cat", "dog"]}, "mail": {"type": "string", "format": "email"}}}}},
        "paths": {"/pets": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Pet"}}}}}}}}},
    }
    from loomwork.operators.generate import Generator, Options

    source = 'import api from "x.json" schema Pet from api.Pet { age: int in 1..15, odd: 1 } dataset D { pets: 10 of Pet }'
    g = Generator(spark, source, Options(imports={"api": openapi.fields_of(document)}))
    pets = g.run()["pets"]
    assert set(pets.columns) == {"id", "kind", "mail", "age", "odd"} and pets.where("id BETWEEN 1 AND 5").count() == 10 and len(g.warnings) == 2
    filled = openapi.with_examples(document, {"pets": pets})
    assert filled["components"]["schemas"]["Pet"]["example"] and len(filled["paths"]["/pets"]["get"]["responses"]["200"]["content"]["application/json"]["example"]) == 5
    out = openapi.export(parse('schema A { a: int in 1..2, b: "x" | "y", c: 2 of B, d: string? } schema B { e: date } dataset D { as: 1 of A }'))
    assert out["components"]["schemas"]["A"]["properties"]["b"]["enum"] == ["x", "y"] and "/as" in out["paths"]


def test_stream(spark, tmp_path):
    from loomwork.streaming.checks import pick_up, stream_counts, stream_errors

    spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 120).alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    rule = "schema E { assume id < 90 }"
    q = pick_up(stream_errors(stream, rule, "E"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    q = stream_counts(stream, rule, "E", "ts").writeStream.outputMode("complete").format("memory").queryName("broken").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(broken) from broken").first()[0] == 10


def test_every_format_has_a_generator(spark):
    from loomwork.operators.generate import Generator, Options

    document = {"components": {"schemas": {"A": {"type": "object", "properties": {f"f{i}": {"type": "string", "format": f} for i, f in enumerate(openapi.FORMATS)}}}}}
    rows = Generator(spark, "schema A from api.A { n: 1 } dataset D { xs: 20 of A }", Options(1, imports={"api": openapi.fields_of(document)})).run()["xs"]
    assert len(rows.columns) == len(openapi.FORMATS) + 1
    assert rows.where(" OR ".join(f"f{i} IS NULL OR length(f{i}) < 4" for i in range(len(openapi.FORMATS)))).count() == 0
    from loomwork.plans import syntax as S

    program = S.parse('schema A { u: uuid(), m: faker.internet.mac(), w: url() }')
    assert openapi.export(program)["components"]["schemas"]["A"]["properties"] == {"u": {"type": "string", "format": "uuid"}, "m": {"type": "string", "format": "mac-address"}, "w": {"type": "string", "format": "uri"}}
