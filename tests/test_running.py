import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import running
from loomwork.operators.generate import ROW, Generator, Options, generate
from loomwork.plans.syntax import parse_expression


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(running, "CHUNK", 7)
    monkeypatch.setattr(running, "BLOCK", 3)


def numbered(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n long, v long").repartition(3)


@pytest.mark.parametrize("count", [0, 1, 6, 7, 8, 49, 50, 400])
def test_sums_before_each_row(spark, small_chunks, count):
    rng = random.Random(count)
    values = [rng.choice([None, -3, 0, 5, 9]) for _ in range(count)]
    got = {r.n: r["__before"] for r in running.before_each(numbered(spark, values), "n", F.col("v"), count).collect()}
    assert got == {i: sum(v or 0 for v in values[:i]) for i in range(count)}


@pytest.mark.parametrize("count", [1, 7, 8, 60])
def test_affine_maps(spark, small_chunks, count):
    rng = random.Random(count)
    rows = [(i, rng.randrange(-1, 3), rng.randrange(5)) for i in range(count)]
    got = {r.n: r.x for r in running.affine(spark.createDataFrame(rows, "n long, a long, b long"), "n", F.col("a"), F.col("b"), count, "x").collect()}
    x = 0
    for i, a, b in rows:
        x = (x * a + b) if i else b
        assert got[i] == x


@pytest.mark.parametrize("count", [1, 7, 15])
def test_rows_in_turn(spark, small_chunks, count):
    """Steps that no short summary gives: a capped sum with the text of all before it."""
    kind = T.StructType([T.StructField("s", T.LongType()), T.StructField("t", T.StringType())])
    step = lambda s, r: F.struct(F.least(F.coalesce(s["s"], F.lit(0)) + r["v"], F.lit(20)).alias("s"), F.concat(F.coalesce(s["t"], F.lit("")), r["v"].cast("string")).alias("t"))
    values = [(7 * i) % 11 for i in range(count)]
    got = {r.n: (r.v, r.s, r.t) for r in running.in_turn(numbered(spark, values), "n", count, kind, step).collect()}
    s, t = 0, ""
    for i, v in enumerate(values):
        s, t = min(s + v, 20), t + str(v)
        assert got[i] == (v, s, t)


def test_linear():
    kind = lambda text: running.linear(parse_expression(text), running.previous_of("x"))
    assert kind('previous("x") + a') is not None and kind('a - 2 * previous("x") / 4') is not None and kind('previous("x") == null ? 5 : previous("x") + 1') is not None
    assert kind('a > 1 ? previous("x") : previous("x") * 2 + b') is not None
    for text in ('previous("x") * previous("x")', 'previous("x") > 3 ? 0 : previous("x") + 1', 'round(previous("x"), 1)', '5 / previous("x")', '1..2 == 1 ? previous("x") : 2'):
        assert kind(text) is None, text


def rows_of(spark, text, name="rows", **options):
    g = Generator(spark, text, Options(seed=3, **options))
    g.run()
    return sorted(g.made[name].frame.collect(), key=lambda r: r[ROW]), g


def test_running_balance_and_what_is_made_of_it(spark, small_chunks):
    text = 'schema B { amount: int in -9..9, balance: previous("balance") + amount, level: balance * 2, before: previous("balance"), interest: previous("interest") * 0.5 + amount } dataset D { rows: 60 of B }'
    rows, _ = rows_of(spark, text)
    total, interest, last = 0, 0.0, None
    for r in rows:
        total, interest = total + r.amount, interest * 0.5 + r.amount
        assert (r.balance, r.level, r.before) == (total, 2 * total, last) and abs(r.interest - interest) < 1e-9 and isinstance(r.balance, int)
        last = total


def test_fields_in_a_circle_through_the_row_before(spark, small_chunks):
    text = 'schema F { a: previous("a") == null ? 1 : previous("b"), b: previous("a") == null ? 1 : previous("a") + previous("b") } dataset D { rows: 20 of F }'
    rows, _ = rows_of(spark, text)
    a, b = 1, 1
    for r in rows:
        assert (r.a, r.b) == (a, b)
        a, b = b, a + b


def test_capped_by_itself(spark, small_chunks):
    rows, _ = rows_of(spark, 'schema C { n: previous("n") >= 3 ? 0 : previous("n") + 1 } dataset D { rows: 30 of C }')
    n = 0
    for r in rows:
        n = 0 if n >= 3 else n + 1
        assert r.n == n


def test_rules_that_read_the_row_before(spark, small_chunks):
    """Each note is near the one before it: attempts of a row are judged against the row that was kept."""
    text = 'schema N { pitch: int in 48..72, prev_pitch: previous("pitch"), assume if prev_pitch != null { pitch - prev_pitch <= 4, prev_pitch - pitch <= 4 } } dataset D { rows: 40 of N }'
    text = text.replace("prev_pitch != null", "not prev_pitch == null")
    rows, g = rows_of(spark, text)
    assert rows[0].prev_pitch is None and len(rows) == 40 and not g.warnings
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.prev_pitch == a.pitch and abs(b.pitch - a.pitch) <= 4
    assert len({r.pitch for r in rows}) > 5


def test_rows_per_parent(spark):
    for each in (0, 1, 3):
        out = generate(spark, f"schema P {{ a: 1 }} schema C {{ b: ^a }} dataset D {{ ps: 3 of P, cs: {each} per ps of C }}".replace("^a", "1"))
        assert out["cs"].count() == 3 * each


@pytest.mark.parametrize("by", ["k", None])
def test_numbers_of_tables(spark, small_chunks, by):
    rng = random.Random(1)
    rows = [(rng.randrange(1000), rng.choice("abc")) for _ in range(60)] + [(5, "x")] * 9
    df = spark.createDataFrame(rows, "k long, c string").repartition(4)
    got = sorted(((r._row, r.k, r.c) for r in running.numbered(df, by).collect()))
    assert [r[0] for r in got] == list(range(69)) and sorted(r[1:] for r in got) == sorted(rows)
    if by:
        assert [r[1:] for r in got] == sorted(rows)
    assert running.numbered(df.limit(0), by).count() == 0


THEN = {
    "order.paid += amount, order.n += 1": lambda s, x: {**s, "paid": s["paid"] + x, "n": s["n"] + 1},
    "order.paid = order.paid * 0.5 + amount": lambda s, x: {**s, "paid": s["paid"] * 0.5 + x},
    "order.paid = order.paid + amount * order.rate, order.n = 2 * order.n - 1": lambda s, x: {**s, "paid": s["paid"] + x * s["rate"], "n": 2 * s["n"] - 1},
    "order.paid = order.paid + amount > 20 ? 0 : order.paid + amount": lambda s, x: {**s, "paid": 0 if s["paid"] + x > 20 else s["paid"] + x},
    "order.paid += amount, order.n = order.paid > 9 ? order.n + 1 : order.n": lambda s, x: {**s, "paid": s["paid"] + x, "n": s["n"] + (s["paid"] + x > 9)},
}


@pytest.mark.parametrize("then", THEN)
def test_changes_of_a_hot_row(spark, small_chunks, monkeypatch, then):
    """One order has most of the payments; every rule is compared with plain changes in order."""
    from loomwork.operators import generate as G

    monkeypatch.setattr(G, "FOLDED", 6)
    rng = random.Random(4)
    pays = [(i, 0 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(1, 8)) for i in range(45)]
    g = Generator(spark, f"schema Pay {{ a: 1 }} then {{ {then} }}")
    orders = spark.createDataFrame([(k, 1.0, 3, 0.5) for k in range(6)], "_row long, paid double, n long, rate double")
    g.made["orders"] = G.Made("orders", g.schemas["Pay"], orders, 6)
    frame = spark.createDataFrame(pays, "_row long, __fk_order long, amount long").repartition(3)
    frame = frame.join(orders.select(F.col("_row").alias("__fk_order"), F.struct("paid", "n", "rate").alias("order")), "__fk_order")
    g.mutate(G.Made("pays", g.schemas["Pay"], frame, 45, {"order": "orders"}))
    got = {r._row: r for r in g.made["orders"].frame.collect()}
    for k in range(6):
        s = {"paid": 1.0, "n": 3, "rate": 0.5}
        for _, to, amount in pays:
            s = THEN[then](s, amount) if to == k else s
        assert abs(got[k].paid - s["paid"]) < 1e-9 and got[k].n == s["n"] and len(got) == 6, then


def test_tables_at_hand(spark):
    text = "schema Pay { order: any of orders, amount: int in 1..9 } then { order.paid += amount } schema Line { n: order_no * 2, x: 7 } dataset D { pays: 50 of Pay, lines: 2 per orders of Line }"
    orders = spark.createDataFrame([(10 * i, 0) for i in range(8)], "order_no long, paid long")
    out = generate_with(spark, text.replace("order_no * 2", "parent.order_no * 2"), orders=orders)
    assert set(out) == {"pays", "lines", "orders"} and out["lines"].count() == 16
    assert {r.n for r in out["lines"].collect()} == {20 * i for i in range(8)}
    pays, total = out["pays"].collect(), out["orders"].agg(F.sum("paid")).first()[0]
    assert total == sum(r.amount for r in pays) and {r.order.order_no for r in pays} <= {10 * i for i in range(8)}


def generate_with(spark, text, **tables):
    return Generator(spark, text, Options(seed=2, tables=tables)).run()


CLAMPS = {
    'previous("n") + a < 0 ? 0 : previous("n") + a': lambda n, a: max(0, n + a),
    'previous("n") + a > 5 ? 5 : previous("n") + a': lambda n, a: min(5, n + a),
    '-3 <= previous("n") - a ? previous("n") - a : -3': lambda n, a: max(-3, n - a),
}


@pytest.mark.parametrize("text", CLAMPS)
def test_sums_that_stop_at_a_bound_run_by_chunks(spark, small_chunks, monkeypatch, text):
    """As many rows as take three levels of chunks; none of them goes in turn."""
    monkeypatch.setattr(running, "in_turn", lambda *_: pytest.fail("rows went in turn"))
    rows, _ = rows_of(spark, f"schema Q {{ a: int in -4..4, n: {text} }} dataset D {{ rows: 120 of Q }}")
    n = 0
    for r in rows:
        n = CLAMPS[text](n, r.a)
        assert r.n == n and isinstance(r.n, int)


def test_what_is_no_clamp():
    kind = lambda text: running.clamp(parse_expression(text), running.previous_of("x"))
    for text in ('previous("x") + a < 0 ? 1 : previous("x") + a', 'previous("x") + a < b ? b : previous("x") + a', '2 * previous("x") < 0 ? 0 : 2 * previous("x")', 'previous("x") < 0 ? 0 : previous("x") + 1', 'a < 0 ? 0 : a'):
        assert kind(text) is None, text


def test_changes_that_stop_at_a_bound_are_composed(spark, small_chunks, monkeypatch):
    rng = random.Random(5)
    pays = [(i, 0 if rng.random() < 0.6 else rng.randrange(5), rng.choice([None, *range(-6, 7)])) for i in range(120)]
    g = Generator(spark, "schema Pay { a: 1 } then { order.n = order.n + amount < 2 ? 2 : order.n + amount }")
    monkeypatch.setattr(g, "fold_once", lambda *_: pytest.fail("rows were folded"))
    from loomwork.operators.generate import Made

    g.made["orders"] = Made("orders", g.schemas["Pay"], spark.createDataFrame([(k, k) for k in range(7)], "_row long, n long"), 7)
    g.mutate(Made("pays", g.schemas["Pay"], spark.createDataFrame(pays, "_row long, __fk_order long, amount long").repartition(3), 120, {"order": "orders"}))
    want = {k: k for k in range(7)}
    for _, to, amount in pays:
        want[to] = max(2, want[to] + (amount or 0))
    assert {r._row: r.n for r in g.made["orders"].frame.collect()} == want


def test_only_rows_of_a_chunk_are_read_in_turn(spark, small_chunks, monkeypatch):
    """The input is computed once, not once for each chunk."""
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda v: seen.add(1) or v, "long").asNondeterministic()
    kind = T.StructType([T.StructField("s", T.LongType())])
    df = numbered(spark, list(range(30))).select("n", told("v").alias("v"))
    out = running.in_turn(df, "n", 30, kind, lambda s, r: F.struct((F.coalesce(s["s"], F.lit(0)) * 2 % 7 + r["v"]).alias("s"))).collect()
    assert len(out) == 30 and seen.value == 30
