import pytest

from loomwork.operators import running
from loomwork.operators.generate import ROW, Generator, Options


def rows_of(spark, text, name="orders"):
    g = Generator(spark, text, Options(seed=4))
    g.run()
    return sorted(g.made[name].frame.collect(), key=lambda r: r[ROW])


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(running, "CHUNK", 7)


def test_numbers_go_on_from_row_to_row(spark):
    rows = rows_of(spark, 'schema I { id: sequence("L-", 1), n: sequenceInt("n", 10), q: int in 1..5 } schema O { items: 0..4 of I, count: count(items) } dataset D { orders: 60 of O }')
    items = [i for r in rows for i in r["items"]]
    assert [i.id for i in items] == [f"L-{k + 1}" for k in range(len(items))] and [i.n for i in items] == list(range(10, 10 + len(items)))
    assert len({len(r["items"]) for r in rows}) == 5 and all(r["count"] == len(r["items"]) for r in rows)


def test_two_levels(spark):
    rows = rows_of(spark, 'schema P { id: sequenceInt("p", 1) } schema I { n: sequenceInt("i", 1), parts: 0..3 of P } schema O { items: 0..3 of I } dataset D { orders: 40 of O }')
    items = [i for r in rows for i in r["items"]]
    assert [i.n for i in items] == list(range(1, len(items) + 1))
    parts = [p.id for i in items for p in i.parts]
    assert parts == list(range(1, len(parts) + 1)) and len(parts) > 60


def test_with_rules_and_references(spark):
    text = 'schema T { k: sequenceInt("k", 1) } schema I { id: sequenceInt("x", 1), q: int in 1..5, t: any of ts } schema O { items: 1..3 of I, total: sum(items.q), assume total > 6 } dataset D { ts: 9 of T, orders: 50 of O }'
    rows = rows_of(spark, text)
    items = [i for r in rows for i in r["items"]]
    assert [i.id for i in items] == list(range(1, len(items) + 1)) and all(r.total > 6 for r in rows) and {i.t.k for i in items} == set(range(1, 10))


def test_one_name_in_several_collections(spark):
    text = 'schema I { id: sequenceInt("s", 1) } schema O { id: sequenceInt("s", 1), items: 2 of I } dataset D { first: 5 of O, second: 5 of O }'
    g = Generator(spark, text, Options(seed=4))
    out = g.run()
    ids = [x for n in ("first", "second") for r in out[n].collect() for x in (r.id, *[i.id for i in r["items"]])]
    assert len(ids) == 30 and sorted(ids) == list(range(1, 31))
