"""Rules that read the row before, and repeated values: streams against tables, and tables against plain loops."""

import datetime as dt
import decimal
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork.operators.check import Checker
from loomwork.streaming import checks, state

RULES = 'schema E { id: unique int in 1..9, v: int in 1..9 assume previous("v") == null or v - previous("v") <= 3 }'
HOUR = dt.timedelta(hours=1)
SCHEMA = "id bigint, k string, ts timestamp, v int, more struct<a: array<int>, at: timestamp>"


@pytest.fixture
def rocks(spark):
    with state.keeping_state(spark):
        yield spark


def events(n: int, seed: int) -> list[tuple]:
    """Rows of few keys, one of them half of all, with equal times, still hours, repeated rows and nulls."""
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for _ in range(n):
        t = start + dt.timedelta(minutes=r.randrange(0, 900), microseconds=r.choice([0, 0, 1, 999_999]))
        out.append((r.choice([None, *range(1, n // 2)]), r.choice(["a", "a", "a", "b", "c", None]), t, r.randrange(10), ([1, None], t)))
    return out + out[:3]


def plain(rows: list[tuple], horizon: dt.timedelta) -> dict:
    """For each key and time, how many rows have something before them; and the sum of what stands before, where times differ."""
    seen = {}
    for k in {r[1] for r in rows if r[1] is not None}:
        own = sorted((r for r in rows if r[1] == k), key=lambda r: r[2])
        for i, r in enumerate(own):
            ok = i > 0 and r[2] - own[i - 1][2] <= horizon
            seen.setdefault((k, r[2]), []).append(ok)
    return {at: sum(x) for at, x in seen.items()}


def test_table_against_a_loop(spark):
    rows = events(300, 1)
    out = state.with_previous(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", ["v"], HOUR).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        if r.k is not None:
            got[r.k, r.ts] = got.get((r.k, r.ts), 0) + r[state.SEEN]
        else:
            assert not r[state.SEEN] and r[state.BEFORE + "v"] is None
    assert got == plain(rows, HOUR)
    # where times differ, what stands before is told by them alone
    for k in "abc":
        own = sorted((r for r in out if r.k == k), key=lambda r: r.ts)
        for x, y in zip(own, own[1:], strict=False):
            if x.ts < y.ts and [r.ts for r in own].count(x.ts) == 1:
                assert y[state.BEFORE + "v"] == (x.v if y.ts - x.ts <= HOUR else None)


def streamed(spark, folder, rows, parts, act):
    """The rows in files of ``parts`` batches, the last of them one row of its own key far later, as a stream through ``act``;
    what comes out, and the state's rows by batch."""
    end = (None, "end", max(r[2] for r in rows) + dt.timedelta(days=3), 0, None)
    for i, part in enumerate([*parts, [end]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"b={i}"))
    stream = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(folder / "in")).drop("b")
    q = act(stream).writeStream.outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).format("parquet").start(str(folder / "out"))
    q.awaitTermination()
    sizes = [[o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]] for p in q.recentProgress]
    return spark.read.parquet(str(folder / "out")).where("k IS NULL OR k <> 'end'"), sizes


def in_parts(rows: list[tuple], n: int) -> list[list[tuple]]:
    """The rows by time in some batches, rows up to ten minutes late in each."""
    r = random.Random(3)
    order = sorted(rows, key=lambda x: x[2] + dt.timedelta(minutes=r.randrange(0, 10)))
    size = -(-len(order) // n)
    return [order[i : i + size] for i in range(0, len(order), size)]


def same(a, b):
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(a) == shown(b.select(*a.columns))


def test_stream_gives_what_the_table_gives_and_forgets(rocks, tmp_path):
    rows = events(300, 2)
    table = state.running_errors(rocks.createDataFrame(rows, SCHEMA), RULES, "E", ["k"], "ts", HOUR)
    assert table.count() > 20
    got, sizes = streamed(rocks, tmp_path, rows, in_parts(rows, 6), lambda s: state.running_errors(s, RULES, "E", ["k"], "ts", HOUR, "11 minutes"))
    same(got, table)
    flat = [s[0] for s in sizes if s]
    assert max(flat) > flat[-1]  # only the last row of the far key remains, with its timer


def test_repeats_of_unique_fields(rocks, tmp_path):
    rows = events(200, 4)
    table = state.repeats(rocks.createDataFrame(rows, SCHEMA), RULES, "E", "ts", HOUR)
    by_id = {}
    for r in sorted(rows, key=lambda r: r[2]):
        if r[0] is not None:
            by_id.setdefault(r[0], []).append(r[2])
    assert table.count() == sum(y - x <= HOUR for t in by_id.values() for x, y in zip(t, t[1:], strict=False)) > 0
    got, _ = streamed(rocks, tmp_path, rows, in_parts(rows, 4), lambda s: state.repeats(s, RULES, "E", "ts", HOUR, "11 minutes"))
    same(got, table)


def test_first_of_each_keeps_one(spark, tmp_path):
    rows = [r for r in events(120, 5) if r[0] is not None]
    got, _ = streamed(spark, tmp_path, rows, [rows], lambda s: state.first_of_each(s, ["id"], "ts", "20 hours"))
    assert sorted(r.id for r in got.collect() if r.k is None or r.k != "end") == sorted({r[0] for r in rows})


def test_odd_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert state.running_errors(empty, RULES, "E", ["k"], "ts", HOUR).count() == 0
    none = spark.createDataFrame([(1, "a", None, 3, None)], SCHEMA)
    assert state.with_previous(none, ["k"], "ts", ["v"], HOUR).count() == 0
    for bad in (lambda: state.with_previous(empty, ["k"], "ts", [], dt.timedelta(0)), lambda: state.with_previous(empty, ["x"], "ts", [], HOUR), lambda: state.repeats(empty, "schema E { a: int }", "E", "ts", HOUR)):
        with pytest.raises(ValueError):
            bad()
    assert state.wanted_before(Checker(RULES), "E") == ["v"]
    assert state.with_previous(empty.withColumn("__x", F.lit(1)), ["k"], "ts", ["__x"], HOUR).columns[-1] == state.BEFORE + "__x"


def test_state_goes_by_buckets_of_keys(rocks, tmp_path):
    """Neither rows nor keys have calls of the state of their own, and every key still has its own row before."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i * 7 % 1500}", start + dt.timedelta(seconds=i), i % 10, None) for i in range(4500)]
    table = state.with_previous(rocks.createDataFrame(rows, SCHEMA), ["k"], "ts", ["v", "id"], HOUR)
    assert table.where(state.SEEN).count() == 3000
    got, sizes = streamed(rocks, tmp_path, rows, in_parts(rows, 2), lambda s: state.with_previous(s, ["k"], "ts", ["v", "id"], HOUR, "11 minutes"))
    same(got, table)
    assert max(s[0] for s in sizes if s) <= 2 * state.BUCKETS + 1


def test_values_of_all_types_come_through_a_stream(rocks, tmp_path):
    kinds = "k double, j string, ts timestamp, big bigint, d double, f float, m decimal(38,10), b binary, day date, local timestamp_ntz, ok boolean, s string, n map<string,int>, l array<double>"
    at = dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    full = (2**53 + 1, float("nan"), 0.1, decimal.Decimal("1234567890123456789.0123456789"), b"\x00\xff", dt.date(2, 1, 1), at, True, 'a"\n\u00e9', {"a": None}, [-0.0, None])
    rows = [(k, j, at + dt.timedelta(seconds=n), *v) for n, (k, j, v) in enumerate([(0.0, "a", full), (-0.0, "a", (None,) * 11), (float("nan"), "a", full), (float("nan"), "a", full), (0.0, None, full), (0.0, 'a"', full), (0.0, "a", full)])]
    df = rocks.createDataFrame(rows, kinds)
    fields = [f for f in df.columns if f not in "kjts"]
    want = state.with_previous(df, ["k", "j"], "ts", fields, HOUR)
    assert want.where(state.SEEN).count() == 3
    end = rocks.createDataFrame([(None, "end", at + dt.timedelta(days=3), *(None,) * 11)], kinds)
    for i, part in enumerate([df, end]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    made = state.with_previous(stream, ["k", "j"], "ts", fields, HOUR)
    assert made.schema.simpleString() == want.schema.simpleString()
    checks.pick_up(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    same(rocks.read.parquet(str(tmp_path / "out")).where("j IS NULL OR j <> 'end'"), want)


def test_rows_later_than_their_bucket_has_gone_are_dropped(rocks, tmp_path):
    """A late row is packed together with one in time, of its own key."""
    ten = dt.datetime(2024, 1, 1, 10)
    row = lambda i, minutes: (i, "a", ten + dt.timedelta(minutes=minutes), 1, None)
    parts = [[row(1, -60), row(2, 0)], [row(3, 10)], [row(4, -90), row(5, 20)]]
    got, _ = streamed(rocks, tmp_path, [r for p in parts for r in p], parts, lambda s: state.with_previous(s, ["k"], "ts", ["id"], HOUR, "11 minutes"))
    assert sorted((r.id, r[state.BEFORE + "id"]) for r in got.collect() if r.id != 1) == [(2, 1), (3, 2), (5, 3)] and got.count() == 4


@pytest.mark.parametrize("name", ["stream_running_rules", "stream_repeated_values"])
def test_queries_take_one_batch_at_a_time(spark, monkeypatch, name):
    """Rows of different batches never come together, however many files a batch has."""
    taken = []

    def pick_up(*args, of=checks.pick_up):
        q = of(*args)
        q.awaitTermination()
        taken.extend(p.numInputRows for p in q.recentProgress if p.numInputRows)
        return q

    monkeypatch.setattr(checks, "pick_up", pick_up)
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*[c[0] for c in want.description]).collect())) == sorted(want.fetchall())
    assert len(taken) == 5 and taken[-1] == 1 and sum(taken) == con.execute("SELECT count(*) + 1 FROM events").fetchone()[0]
