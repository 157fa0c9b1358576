import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.operators import cells
from loomwork.operators.describe import describe_json, schema_text
from loomwork.operators.profile import profile


def plain_tag(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "int" if v == int(v) else "decimal"
    if isinstance(v, str):
        return "date" if re.match(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$|^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T\d\d:\d\d:\d\d", v) else "string"
    return "array" if isinstance(v, list) else "object"


def some_rows(n=300):
    rng = random.Random(8)
    values = [None, True, 3, -7, 2.0, 2.5, 1e30, "x", "2024-03-05", "2024-13-05", "2024-03-05T10:00:00Z", "12", [1], [], {"a": 1}, {}, 12345678901234567890]
    return [{k: rng.choice(values) for k in ("a", "b c", "d.e", "ü") if rng.random() < 0.8} for _ in range(n)]


def test_tags_are_counted_for_each_cell(spark):
    rows = some_rows()
    texts = [json.dumps(r) for r in rows] + ["[1, 2]", "not json", None, "7"]
    df = spark.createDataFrame([(t,) for t in texts], "props string").repartition(3)
    want = Counter((k, plain_tag(v)) for r in rows for k, v in r.items())
    for column in (df, df.select(F.try_parse_json("props").alias("props"))):
        assert {(r["key"], r["tag"]): r["n"] for r in cells.tag_counts(column, "props").collect()} == want
    found = {c.name: c for c in cells.cells_of(df, "props")}
    assert all(sum(c.counts.values()) == len(texts) and c.nullable and c.mixed and c.type == "array" for c in found.values())
    assert cells.cells_of(df.limit(0), "props") == [] and cells.typed(df.limit(0), "props").columns == []


@pytest.mark.parametrize(("tags", "type_"), [(["int", "int"], "int"), (["int", "decimal"], "decimal"), (["int", "string", "null"], "string"), (["date", "string"], "string"), (["object", "int"], "object"), (["object", "array"], "array"), (["null"], "null"), ([], "null"), (["boolean", "int", "decimal"], "string")])
def test_common_types(tags, type_):
    assert cells.common_type(tags) == type_


def test_columns_of_common_types(spark):
    rows = [{"n": 1, "m": 1, "s": 1, "o": {"x": 1}, "l": [1, 2], "b": True}, {"n": 2.5, "m": "two", "s": None, "o": {"x": 2, "y": "z"}, "l": [], "b": False}, {"n": 3, "o": 5}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "props string")
    out = cells.typed(df, "props")
    assert dict(out.dtypes) == {"b": "boolean", "l": "array<bigint>", "m": "string", "n": "double", "o": "struct<x:bigint,y:string>", "s": "bigint"}
    got = out.collect()
    assert [r.n for r in got] == [1.0, 2.5, 3.0] and [r.m for r in got] == ["1", "two", None] and got[1].o.y == "z" and got[2].o is None
    text = describe_json(df, "props", "things")
    assert "schema O {" in text and "n: " in text and profile(out)["n"].type == "decimal"


def test_equal_structures_are_one_schema(spark):
    rows = [(i, (f"{i} Main", f"T{i}", (i * 3, "a")), (f"{i} Oak", f"V{i}", (i * 5, "a")), (f"p{i}", i)) for i in range(30)]
    inner = "struct<street:string,town:string,spot:struct<level:int,side:string>>"
    df = spark.createDataFrame(rows, f"id int, billing_address {inner}, shipping_address {inner}, contact struct<name:string,rank:int>")
    text = "\n".join(schema_text("Order", profile(df)))
    assert text.count("schema ") == 4 and "shipping_address: BillingAddress" in text and "billing_address: BillingAddress" in text and "contact: Contact" in text


def test_unlike_structures_stay_apart(spark):
    df = spark.createDataFrame([(i, ("x" * i, i), ("y" * i, None if i % 2 else i)) for i in range(1, 30)], "id int, a struct<s:string,n:int>, b struct<s:string,n:int>")
    text = "\n".join(schema_text("Row", profile(df)))
    assert "schema A {" in text and "schema B {" in text
