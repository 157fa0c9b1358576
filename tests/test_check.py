from loomwork.operators.check import Checker, check_json_schema

RULES = """
schema Item { p: int, secret: private int
  assume p > 0 and p < 10
  assume if kind == "a" { p > 2, q > 1 }
  assume secret > 0
  assume q / z > 1
}
dataset D { items: 1 of Item, validate { sum(items.p) > 3, all(items, .p > 0), count(items.q) == 2, 1 / (count(items) - 3) > 0, count(missing) == 0 } }
"""


def items(spark):
    return spark.createDataFrame([(1, "a", 5, 1), (20, "b", None, 0), (-1, "a", 0, 1)], "p int, kind string, q int, z int")


def test_rows(spark):
    rows = [sorted((e["rule"], e["kind"]) for e in r["errors"]) for r in Checker(RULES).rows(items(spark), "Item").collect()]
    assert rows[0] == [('if kind == "a": p > 2', "violation")]
    assert rows[1] == [("p < 10", "violation"), ("q / z > 1", "error")]
    assert rows[2] == [('if kind == "a": p > 2', "violation"), ('if kind == "a": q > 1', "violation"), ("p > 0", "violation"), ("q / z > 1", "violation")]


def test_report(spark):
    report = Checker(RULES).collection(items(spark), "Item")
    assert (report.valid, report.rows, report.failed) == (False, 3, 3) and report.skipped == ["secret > 0"]
    assert not Checker(RULES).dataset({}, {"items": "Item"})["items"].valid
    empty = Checker(RULES).collection(items(spark).limit(0), "Item")
    assert empty.valid and empty.rows == 0


def test_dataset_rules(spark):
    got = {r["rule"]: (r["ok"], r["failed"]) for r in Checker(RULES).whole({"items": items(spark)}, "D").collect()}
    assert got["sum(items.p) > 3"] == (True, False) and got["all(items, p > 0)"] == (False, False) and got["count(items.q) == 2"] == (True, False)
    assert got["1 / count(items) - 3 > 0"] == (False, True) and got["count(missing) == 0"] == (True, False)


def test_mapping():
    assert Checker("schema LineItem { a: 1 } schema City { a: 1 } schema Box { a: 1 }").mapping(["line_items", "cities", "boxes", "none"]) == {"line_items": "LineItem", "cities": "City", "boxes": "Box"}


def test_json_schema(spark):
    schema = {
        "type": "object", "required": ["a"],
        "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "string", "format": "email"}, "c": {"type": "array", "items": {"type": "object", "properties": {"d": {"type": "number", "maximum": 1}}}}, "e": {"type": "boolean"}},
    }
    df = spark.sql("select 1 a, 'x@y.de' b, array(named_struct('d', 2.0D)) c, 'no' e union all select null, 'nope', array(), 'x'")
    got = sorted(sorted((e["path"], e["keyword"]) for e in r["errors"]) for r in check_json_schema(df, schema).collect())
    assert got == [[("/a", "minimum"), ("/c/*/d", "maximum"), ("/e", "type")], [("/a", "required"), ("/b", "format"), ("/e", "type")]]


def test_no_rules(spark):
    assert Checker("schema A { x: 1 }").rows(items(spark), "A").select("errors").first()[0] == []
