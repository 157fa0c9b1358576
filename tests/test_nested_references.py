import pytest
from pyspark.sql import functions as F

from loomwork.operators.generate import ROW, Generator, Options

PARTS = "schema Part { id: sequenceInt(\"p\", 1), price: int in 1..99, active: id > 500 } "


def made(spark, text, seed=3, **tables):
    g = Generator(spark, text, Options(seed=seed, tables=tables))
    return g.run(), g


def test_draws_from_all_rows_and_reads_them(spark):
    text = PARTS + """
    schema Item { part: any of parts, n: int in 1..3, cost: part.price * n }
    schema Order { items: 2..5 of Item, total: sum(items.cost) }
    dataset D { parts: 20000 of Part, orders: 6000 of Order }"""
    out, _ = made(spark, text)
    parts = {r.id: r for r in out["parts"].collect()}
    rows = out["orders"].collect()
    seen = [i for r in rows for i in r["items"]]
    assert len(rows) == 6000 and all(2 <= len(r["items"]) <= 5 for r in rows)
    assert all(i.part == parts[i.part.id] and i.cost == i.part.price * i.n for i in seen)
    assert all(r.total == sum(i.cost for i in r["items"]) for r in rows)
    assert len({i.part.id for i in seen}) > 12_000 and max(i.part.id for i in seen) > 19_900
    again, _ = made(spark, text)
    assert sorted(map(repr, again["orders"].collect())) == sorted(map(repr, rows))


def test_conditions_two_levels_private_and_optional(spark):
    text = PARTS + """
    schema Piece { part: any of parts where .id > 990, price: part.price }
    schema Item { hidden: private any of parts, price: hidden.price, pieces: 0..2 of Piece, spare: any of parts? }
    schema Order { items: 1..3 of Item, one: Piece }
    dataset D { parts: 1000 of Part, orders: 300 of Order }"""
    out, _ = made(spark, text)
    price = {r.id: r.price for r in out["parts"].collect()}
    rows = out["orders"].collect()
    items = [i for r in rows for i in r["items"]]
    pieces = [p for i in items for p in i.pieces] + [r.one for r in rows]
    assert all(p.part.id > 990 and p.price == price[p.part.id] for p in pieces) and len({p.part.id for p in pieces}) == 10
    assert all("hidden" not in i and i.price in price.values() for i in items)
    assert {i.spare is None for i in items} == {True, False}


def test_rules_judge_references_inside(spark):
    text = PARTS + """
    schema Item { part: any of parts, cost: part.price }
    schema Order { items: 2 of Item, total: sum(items.cost), assume total > 120 }
    dataset D { parts: 500 of Part, orders: 200 of Order }"""
    out, g = made(spark, text)
    rows = out["orders"].collect()
    assert len(rows) == 200 and all(r.total > 120 and r.total == sum(i.part.price for i in r["items"]) for r in rows) and not g.warnings


def test_rows_in_turn_refer_too(spark):
    text = PARTS + """
    schema Item { part: any of parts }
    schema Order { items: 1 of Item, n: previous("n") > 2 ? 0 : previous("n") + 1 }
    dataset D { parts: 50 of Part, orders: 40 of Order }"""
    _, g = made(spark, text)
    rows = sorted(g.made["orders"].frame.collect(), key=lambda r: r[ROW])
    assert [r.n for r in rows] == [(i + 1) % 4 for i in range(40)] and len({r["items"][0].part.id for r in rows}) > 15


@pytest.mark.parametrize("count", [0, 1])
def test_few_rows_to_refer_to(spark, count):
    out, _ = made(spark, f"{PARTS} schema I {{ part: any of parts }} schema O {{ items: 2 of I }} dataset D {{ parts: {count} of Part, orders: 3 of O }}")
    found = [i.part for r in out["orders"].collect() for i in r["items"]]
    assert len(found) == 6 and all((p is None) == (count == 0) for p in found)


def test_tables_at_hand(spark):
    parts = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("price"))
    out, _ = made(spark, "schema I { part: any of parts } schema O { items: 4 of I } dataset D { orders: 50 of O }", parts=parts)
    got = [i.part for r in out["orders"].collect() for i in r["items"]]
    assert {p.key for p in got} == set(range(30)) and all(p.price == 2 * p.key for p in got)
