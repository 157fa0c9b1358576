import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork import cli, config
from loomwork.operators import text
from loomwork.operators.generate import Generator, Options
from loomwork.plans import syntax as S
from loomwork.plugins import Plugin, Registry, columns

PLUGIN = """
from pyspark.sql import functions as F
from pyspark.sql import types as T
from loomwork.plans import syntax as S
from loomwork.plugins import Plugin, columns

def doubled(draw, x):
    return x * 2

def reading(parser):
    name = parser.kind("name", "a name")
    return S.Let(name, S.Literal(7))

plugin = Plugin("mine", {"doubled": columns(doubled, T.LongType()), "spin": columns(lambda draw: draw(), T.DoubleType())}, {"lucky": reading})
"""


def test_registry(spark, tmp_path):
    (tmp_path / "p.py").write_text(PLUGIN)
    r = Registry()
    assert r.load(tmp_path) == ["mine"] == r.names()
    with pytest.raises(ValueError):
        r.load(tmp_path / "p.py")
    source = S.parse("lucky seven schema A { a: int in 1..9, b: doubled(a), c: mine.doubled(b), d: spin(), e: seven } dataset D { xs: 50 of A }", r.statements())
    rows = Generator(spark, source, Options(3, functions=r.functions())).run()["xs"]
    assert rows.where("b <> 2 * a OR c <> 4 * a OR d < 0 OR d >= 1 OR e <> 7").count() == 0 and rows.select("d").distinct().count() == 50
    assert r.unregister("mine") and not r.unregister("mine") and not r.functions()
    with pytest.raises(ValueError):
        Registry(Plugin("a", {}, {"x": None}), Plugin("b", {}, {"x": None}))
    assert columns(lambda draw: F.lit(1), T.IntegerType())


def test_settings(tmp_path):
    (tmp_path / "loomwork.toml").write_text('seed = 4\npretty = true\nplugins = ["p.py"]\nattempts = 20\n')
    (tmp_path / "in").mkdir()
    found = config.load(config.find(tmp_path / "in"))
    assert (found.seed, found.pretty, found.plugins, found.attempts, found.folder) == (4, True, ["p.py"], 20, str(tmp_path))
    assert config.load(None).format == "json"
    for text_ in ("sed = 4", "seed = 'x'", "log_level = 'loud'"):
        (tmp_path / "bad.toml").write_text(text_)
        with pytest.raises(ValueError):
            config.load(tmp_path / "bad.toml")


def test_flags(spark, tmp_path, capsys):
    (tmp_path / "p.py").write_text(PLUGIN)
    (tmp_path / "d.txt").write_text('schema Item { id: unique int in 1..50, kind: 0.9: "a" | "b", twice: doubled(id), part: Part } schema Part { xs: 2 of 7 } dataset D { items: 20 of Item }')
    (tmp_path / "loomwork.json").write_text(json.dumps({"seed": 5, "plugins": ["p.py"], "format": "csv"}))
    run = lambda *a: cli.main([a[0], str(tmp_path / a[1]), *a[2:]])
    assert run("generate", "d.txt", "--out", str(tmp_path / "one.csv"), "--csv-single", "--csv-delimiter", ";", "--csv-arrays", "count") == 0
    lines = (tmp_path / "one.csv").read_text().split("\n")
    assert lines[:2] == ["# items", "id;kind;part.xs;twice"] and len(lines) == 23 and all(x.split(";")[2] == "2" for x in lines[2:22])
    assert run("generate", "d.txt", "--out", str(tmp_path / "n"), "--csv-nested", "json", "--csv-no-header", "--no-auto-plugins", "--log-level", "error") == 0
    assert "{" in spark.read.text(str(tmp_path / "n/items")).first()[0]
    assert run("generate", "d.txt", "--out", str(tmp_path / "j"), "--format", "json", "--pretty", "--seed", "2") == 0
    assert spark.read.text(str(tmp_path / "j/items")).first()[0] == "{"
    with pytest.raises(Exception, match="doubled"):
        run("generate", "d.txt", "--out", str(tmp_path / "x"), "--no-config")
    spec = {"openapi": "3.0.3", "paths": {}, "components": {"schemas": {"Item": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "maximum": 60}, "kind": {"enum": ["a"]}}}}}}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    capsys.readouterr()
    assert run("generate", "d.txt", "--validate", str(tmp_path / "s.json"), "--validate-only", "--out", str(tmp_path / "none")) == 1
    assert "/kind enum" in capsys.readouterr().out and not (tmp_path / "none").exists()
    assert run("generate", "d.txt", "--oas-source", str(tmp_path / "s.json"), "--oas-output", str(tmp_path / "o.json")) == 0
    assert json.loads((tmp_path / "o.json").read_text())["components"]["schemas"]["Item"]["example"]["id"] > 0
    spark.range(40).selectExpr("id", "concat('u', id, '@example.com') AS mail", "CASE WHEN id % 4 = 0 THEN 'x' ELSE 'y' END AS k").write.parquet(str(tmp_path / "t.parquet"))
    capsys.readouterr()
    assert run("describe", "t.parquet", "--dataset-name", "Mine", "--collection-name", "people", "--no-formats", "--no-weights") == 0
    said = capsys.readouterr().out
    assert "dataset Mine" in said and "schema People" in said and "email()" not in said and '"y" | "x"' in said
    assert run("describe", "t.parquet", "--max-enum", "1", "--ts-only") == 0 and "dataset" not in capsys.readouterr().out


def test_watch(tmp_path):
    f, seen = tmp_path / "x", []
    f.write_text("1")

    def run():
        seen.append(f.read_text())
        f.write_text("2")
        time.sleep(0.01)

    cli.watch(str(f), run, wait=0.01, rounds=2)
    assert seen == ["1", "2"]


def test_chains(spark):
    df = spark.createDataFrame([("a b a c",), ("a b",), (None,), ("",), (" x  y z ",)], "t string")
    counts = {(tuple(r.prefix), r.next): r.n for r in text.transitions(df, "t", 1).collect()}
    assert counts == {(("a",), "b"): 2, (("b",), "a"): 1, (("a",), "c"): 1, (("x",), "y"): 1, (("y",), "z"): 1}
    assert {(tuple(r.prefix), r.next) for r in text.transitions(df, "t", 2, characters=True).where("next = 'c'").collect()} == {(("a", " "), "c")}
    chain = text.chain_of(text.transitions(df, "t", 1))
    rows = spark.range(3000).select("id", F.array(F.lit("a")).alias("prefix"))
    walked = text.walk(rows, chain, 1, "id", seed=1).groupBy("units").count().collect()
    shares = {r.units[1]: r["count"] / 3000 for r in walked}
    assert set(shares) == {"b", "c"} and 0.6 < shares["b"] < 0.73
    assert text.walk(rows.limit(1), chain, 9, "id").first().units[:1] == ["a"]
    assert text.walk(rows.select("id", F.array(F.lit("q")).alias("prefix")), chain, 3, "id").first().units == ["q"]
