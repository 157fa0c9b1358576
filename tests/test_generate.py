import pytest
from pyspark.sql import functions as F

from loomwork.functions.compiler import CompileError
from loomwork.operators.generate import ConstraintError, Generator, Options, generate


def rows(spark, fields, n=200, extra="", seed=1, **more):
    return generate(spark, f"schema A {{ {fields} }} {extra} dataset D {{ xs: {n} of A }}", seed, **more)["xs"]


def test_ranges_and_weights(spark):
    df = rows(spark, 'a: int in 3..5, b: decimal(1) in 0..2, c: 0.8: "x" | "y", d: date in 2020..2021, e: boolean, f: int in 1..2?, g: string?', 2000)
    got = df.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.avg((F.col("c") == "x").cast("int")), F.min("d"), F.max("d"), F.avg(F.col("f").isNull().cast("int")), F.avg(F.col("g").isNull().cast("int"))).first()
    assert got[0:2] == (3, 5) and 0 <= got[2] and got[3] <= 2 and 0.75 < got[4] < 0.85 and got[5].year == 2020 and got[6].year == 2021 and 0.25 < got[7] < 0.35 and 0.45 < got[8] < 0.55


def test_same_seed_same_rows_whatever_the_partitions(spark):
    a, b = (rows(spark, "a: int in 1..1000000, u: uuid()").repartition(n).collect() for n in (1, 7))
    assert sorted(a) == sorted(b)
    assert sorted(a) != sorted(rows(spark, "a: int in 1..1000000, u: uuid()", seed=2).collect())


def test_rules_and_violations(spark):
    assert rows(spark, "a: int in 1..9, b: int in 1..9 assume a < b").where("a >= b").count() == 0
    bad = generate(spark, "schema A { a: int in 1..9, b: int in 1..9 assume a < b } dataset D violating { xs: 100 of A }")["xs"]
    assert bad.where("a < b").count() == 0
    with pytest.raises(ConstraintError):
        rows(spark, "a: int in 1..9 assume a > 100", 10, strict=True)


def test_nested_and_parent(spark):
    df = rows(spark, "cur: \"E\" | \"U\", items: 1..4 of B, n: count(items), total: sum(items.q), none: 0 of B", extra="schema B { q: int in 1..9, cur: ^cur }")
    assert df.where("n <> size(items) OR NOT n BETWEEN 1 AND 4 OR size(none) <> 0").count() == 0
    assert df.where("exists(items, x -> x.cur <> cur)").count() == 0
    assert df.where("total <> aggregate(items, 0L, (s, x) -> s + x.q)").count() == 0


def test_references_mutations_and_private(spark):
    source = """
    schema C { id: sequence("C", 1), s: "on" | "off", hidden: private int in 1..5 }
    schema P { c: any of cs where .s == "on", amount: int in 1..5 } then { c.paid += amount }
    dataset D { cs: 20 of C { paid: int in 0..0 }, ps: 100 of P, validate { count(ps) == 100 } }
    """
    out = generate(spark, source, 4)
    cs, ps = out["cs"], out["ps"]
    assert "hidden" not in cs.columns and ps.where("c.s <> 'on' OR c IS NULL").count() == 0
    assert cs.agg(F.sum("paid")).first()[0] == ps.agg(F.sum("amount")).first()[0]
    assert ps.join(cs, ps["c.id"] == cs["id"]).where("c.paid <> paid").count() == 0


def test_previous_unique_sequence_cycle(spark):
    out = rows(spark, 'id: unique int in 1..200, n: sequenceInt("n", 5), a: [10, 20, 30], p: previous("n"), code: unique "a" | "b"', 200)
    got = out.agg(F.count_distinct("id"), F.min("n"), F.max("n"), F.count("p"), F.count_distinct("code")).first()
    assert got[:] == (200, 5, 204, 199, 2)
    assert out.where("p <> n - 1").count() == 0


def test_circles_and_negative_sizes(spark):
    with pytest.raises(CompileError, match="Circular"):
        rows(spark, "a: b + 1, b: a + 1")
    with pytest.raises(Exception):
        rows(spark, "a: -1 of 5", 3).collect()
    assert rows(spark, "a: 1", 0).count() == 0


def test_dataset_rules_are_retried_then_warned_of(spark):
    g = Generator(spark, "schema A { a: int in 1..2 } dataset D { xs: 1 of A, validate { sum(xs.a) == 2 } }", Options(seed=9))
    assert g.run()["xs"].first()["a"] == 2
    g = Generator(spark, "schema A { a: 1 } dataset D { xs: 1 of A, validate { sum(xs.a) == 2 } }")
    g.run()
    assert g.warnings


def test_changes_that_read_the_referenced_row_are_made_row_by_row(spark):
    from loomwork.catalogue import _made
    from loomwork.operators.generate import Generator

    g = Generator(spark, "schema P { a: 1 } then { i.left = i.left * 2 - amount, i.paid += amount, i.twice += i.paid }")
    g.made["is"] = _made(g, "is", spark.createDataFrame([(0, 100.0, 0), (1, 5.0, 7)], "_row long, left double, paid int"), 2)
    rows = spark.createDataFrame([(2, 0, 1.0), (0, 0, 10.0), (1, 0, 20.0)], "_row long, __fk_i long, amount double")
    made = _made(g, "ps", rows, 3)
    made.schema, made.references = g.schemas["P"], {"i": "is"}
    g.mutate(made)
    got = [tuple(r) for r in g.made["is"].frame.orderBy("_row").collect()]
    assert got == [(0, 719.0, 31, 71.0), (1, 5.0, 7, None)]


def test_rules_on_references_are_met_by_drawing_them_anew(spark):
    source = """
    schema City { id: sequence("C", 1), size: int in 1..3 }
    schema Road { a: any of cities, b: any of cities where .size < 3, far: a.size - b.size, assume not a.id == b.id assume far >= 0 }
    dataset D { cities: 6 of City, roads: 400 of Road }
    """
    g = Generator(spark, source, Options(2))
    roads = g.run()["roads"]
    assert roads.count() == 400 and not g.warnings
    assert roads.where("a.id = b.id OR a.size < b.size OR b.size = 3 OR far <> a.size - b.size").count() == 0
    assert sorted(map(str, roads.repartition(7).collect())) == sorted(map(str, Generator(spark, source, Options(2)).run()["roads"].collect()))


def test_rows_that_no_attempt_satisfies_are_counted(spark):
    source = "schema C { id: sequence(\"C\", 1) } schema R { a: any of cs, b: any of cs assume not a.id == b.id } dataset D { cs: 1 of C, rs: 9 of R }"
    g = Generator(spark, source)
    assert g.run()["rs"].count() == 9 and "9 of 9 rows" in g.warnings[0]
    g = Generator(spark, "schema A { a: int in 1..9 assume a > 100 } dataset D { xs: 10 of A }", Options(attempts=3))
    g.run()
    assert "10 of 10 rows satisfy no attempt of 3" in g.warnings[0]
    g = Generator(spark, "schema A { a: int in 1..9 assume a > 100 } dataset D { xs: 10 of A }", Options(report=False))
    g.run()
    assert not g.warnings


def test_plain_strings_follow_their_names(spark):
    from loomwork.operators.generate import named_string

    assert [named_string(f, s) for f, s in (("name", "Company"), ("name", "Pet"), ("companyName", "A"), ("contactPerson", "A"), ("productTitle", "A"), ("code", "Business"), ("note", "A"))] == ["companyName", "fullName", "companyName", "fullName", "faker.commerce.productName", None, None]
    df = rows(spark, "name: string, product: string, code: string", 50)
    assert df.where("name NOT LIKE '% %' OR size(split(product, ' ')) < 3 OR code LIKE '% %'").count() == 0


def test_warnings_have_kinds(spark):
    from loomwork.operators import generate as G

    source = """
    schema C { id: unique int in 1..3 }
    schema R { c: any of cs, n: int in 1..2 assume n > 5 } then { d.x += n }
    dataset D { cs: 9 of C, rs: 4 of R, validate { count(rs) == 5 } }
    """
    g = Generator(spark, source, Options(dataset_attempts=1, attempts=2))
    g.run()
    assert {w.kind for w in g.warnings} == {G.UNIQUE, G.RETRIES, G.TARGET} and len(g.warnings) == len(set(g.warnings))
