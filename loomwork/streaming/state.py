"""Rules that need the row before, on streams and on tables alike: ``previous("field")`` by key, and repeated values.

"Before" goes by event time within a key; rows of equal time follow each other by a hash of the row. A row is before another
only if it is no more than a horizon older, so a key that has been still for longer has nothing before it, and its
state goes.

On a stream one stateful operator does the work. Rows wait in it until the watermark has passed them, as until then a late row
may still come between; then they leave in order, each with the row before it. The last row of a key stays until the watermark
is a horizon past it, so the state follows the open keys, not the length of the stream. Calls of the state by row or by key
cost far more than the work itself: so keys are dealt into BUCKETS by their hash, rows come packed as Arrow, the state of a
bucket is a few packed tables and one timer, and a bucket's rows are put in order by whole columns. Memory: a task holds the
rows of one bucket that wait, and, packed, those that its buckets let go in one batch.

On a table the same is a window over spans of time as long as the horizon, not over whole keys: the row before lies in the
same span or is the last of the span before, which an equi-join hands on. A key that holds a third of all rows is spread over
its spans.

Defined results: rows without a time can't be put in order and are left out; rows without a key have no row before them and
pass at once. Rows later than the watermark may be dropped, and are if their bucket has let rows go past them. Repeated rows follow each other. An empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.builtins import constant
from ..functions.compiler import Scope
from ..functions.values import Value, literal
from ..operators.check import Checker, rules_of
from ..plans import syntax as S

#: Rows of equal time follow each other by TIE; AT is the time in microseconds.
AT, TIE, SEEN, BEFORE = "__at", "__tie", "__seen", "__before_"
#: In packed rows: the key as text (null where a part of it is) and its bucket; and the column of packed rows.
KEY, BUCKET, ROWS = "__key", "__bucket", "__rows"
#: Keys share the calls of a bucket. Rows are packed together up to so many or so many bytes, and let go in tables of so many.
BUCKETS, PACKED_ROWS, PACKED_BYTES, GONE_ROWS = 512, 1 << 18, 32 << 20, 20_000
#: The session setting that stateful operators of Python need, and its value.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Has each batch put the state stores it loaded away again, local files and all, where a stream is picked up time and again.
UNLOAD = ("spark.sql.streaming.stateStore.unloadOnCommit", "true")
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def keeping_state(spark: SparkSession, unload: bool = False):
    """Sets PROVIDER (and UNLOAD) while streams are started, and sets back what was there."""
    wanted = [PROVIDER, UNLOAD] if unload else [PROVIDER]
    old = [(k, spark.conf.get(k)) for k, _ in wanted]
    for k, v in wanted:
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old:
            spark.conf.set(k, v)


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _packed(f: T.StructField) -> tuple[Column, T.DataType]:
    """A column as Python workers can hold it without loss: instants as microseconds, nested values as JSON."""
    c = _q(f.name)
    if isinstance(f.dataType, T.TimestampType):
        return F.unix_micros(c), T.LongType()
    if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(c, _JSON), T.StringType()
    return c, f.dataType


def _unpacked(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(c)
    return F.from_json(c, t, _JSON) if isinstance(t, T.StructType | T.ArrayType | T.MapType) else c


def _marked(df: DataFrame, time: str) -> DataFrame:
    """``df`` without rows that have no time, with AT and TIE."""
    hashed = [_q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return df.where(_q(time).isNotNull()).withColumn(AT, F.unix_micros(_q(time).cast("timestamp"))).withColumn(TIE, F.xxhash64(*hashed))


def _key_text(types: list[T.DataType], columns: list[Column]) -> Column:
    """One text for each key: equal just where the keys are (0.0 is -0.0, save within nested keys); null where a part is."""
    texts = []
    for t, c in zip(types, columns, strict=True):
        if isinstance(t, T.BinaryType):
            c = F.hex(c)
        elif isinstance(t, T.FloatType | T.DoubleType):
            c = c + F.lit(0.0)
        texts.append(c.cast("string"))
    if len(texts) == 1:
        return texts[0]
    whole = F.lit(True)
    for c in texts:
        whole = whole & c.isNotNull()
    return F.when(whole, F.to_json(F.array(*texts)))


def _to_bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _of_bytes(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to BUCKET, the greatest AT and the packed ROWS of each bucket."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        buckets = table[BUCKET].to_numpy()
        order = np.argsort(buckets, kind="stable")
        table, buckets = table.drop_columns(BUCKET).take(pa.array(order)), buckets[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        parts = [table.slice(i, j - i) for i, j in zip(starts, [*starts[1:], len(buckets)], strict=True)]
        columns = [pa.array(buckets[starts], pa.int32()), pa.array([pc.max(p[AT]).as_py() for p in parts], pa.int64()), pa.array([_to_bytes(p) for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[BUCKET, AT, ROWS])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= PACKED_ROWS or sum(h.nbytes for h in held) >= PACKED_BYTES:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in b.column(0):
            yield from _of_bytes(packed.as_py()).to_batches()


class _Before(StatefulProcessor):
    """Lets the rows of a bucket go in order of time once the watermark has passed them, each with the last of its key before it."""

    def __init__(self, own: list[str], wanted: list[str], horizon: int):
        self.own, self.wanted, self.horizon = own, wanted, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        # the last row of each key (null: none), how far the bucket's rows have gone, and the timer (null: none)
        self.last = handle.getValueState("last", "rows binary, passed bigint, wake bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, passed, wake = self._state()
        came, first = [], None
        for r in rows:
            packed = r[ROWS]
            table = _of_bytes(packed)
            n = table.num_rows
            if passed is not None:
                table = table.filter(pc.greater(table[AT], passed))
            lone = table.filter(pc.is_null(table[KEY]))
            if lone.num_rows:
                yield from self._out(lone, np.full(lone.num_rows, -1), lone)
                table = table.filter(pc.is_valid(table[KEY]))
            if table.num_rows:
                came.append((packed if table.num_rows == n else _to_bytes(table),))
                least = pc.min(table[AT]).as_py()
                first = least if first is None else min(first, least)
        if came:
            self.waiting.appendList(came)
            self._keep(last, passed, wake, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, passed, wake = self._state()
        if wake is None or wake > expiredTimerInfo.getExpiryTimeInMs():
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ends = [AT, TIE, KEY, *self.wanted]
        parts = [_of_bytes(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        least = []
        known = _of_bytes(last) if last is not None else None
        if parts:
            rows = pa.concat_tables(parts)
            isdue = pc.less_equal(rows[AT], passed)
            due, still = rows.filter(isdue), rows.filter(pc.invert(isdue))
            if due.num_rows:
                both = due.select(ends) if known is None else pa.concat_tables([known, due.select(ends)])
                both = both.combine_chunks()
                old = both.num_rows - due.num_rows
                codes = pc.rank(both[KEY], tiebreaker="dense").to_numpy()
                at = both[AT].to_numpy()
                order = np.lexsort((both[TIE].to_numpy(), at, codes))
                same = codes[order[1:]] == codes[order[:-1]]
                near = same & (at[order[1:]] - at[order[:-1]] <= self.horizon)
                before = np.full(len(order), -1)
                before[order[1:]] = np.where(near, order[:-1], -1)
                mine = order[order >= old]
                yield from self._out(due.take(pa.array(mine - old)), before[mine], both)
                known = both.take(pa.array(order[np.append(~same, True)]))
                if still.num_rows:
                    self.waiting.put([(_to_bytes(still),)])
                else:
                    self.waiting.clear()
            if still.num_rows:
                least.append(pc.min(still[AT]).as_py())
        if known is not None:
            known = known.filter(pc.greater_equal(known[AT], passed - self.horizon))
            if known.num_rows:
                least.append(pc.min(known[AT]).as_py() + self.horizon + 1)
        if least:
            self._keep(_to_bytes(known) if known is not None and known.num_rows else None, passed, None, min(least))
        else:
            self.last.clear()

    def _state(self) -> tuple:
        return tuple(self.last.get()) if self.last.exists() else (None, None, None)

    def _keep(self, last: bytes | None, passed: int | None, wake: int | None, micros: int) -> None:
        """Keeps the state with the earlier timer of ``wake`` and ``micros``."""
        at = -(-micros // 1000)
        if wake is None or at < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
            wake = at
        self.last.update((last, passed, wake))

    def _out(self, rows: pa.Table, before: np.ndarray, both: pa.Table) -> Iterator[Row]:
        """The rows with SEEN and what stands at ``before`` in ``both`` (-1: nothing)."""
        at = pa.array(before, mask=before < 0)
        columns = [*[rows[n] for n in self.own], pc.is_valid(at), *[both[w].take(at) for w in self.wanted]]
        made = pa.Table.from_arrays(columns, names=[*self.own, SEEN, *[f"b{i}" for i in range(len(self.wanted))]])
        for i in range(0, made.num_rows, GONE_ROWS):
            yield Row(**{ROWS: _to_bytes(made.slice(i, GONE_ROWS))})

    def close(self) -> None:
        pass


def with_previous(df: DataFrame, key: list[str], time: str, fields: list[str], within: timedelta, late: str = "10 minutes") -> DataFrame:
    """``df`` with SEEN (whether a row of the same ``key`` lies before, no more than ``within`` older) and, for each of
    ``fields``, BEFORE and its name: that row's value. For streams and tables; ``late`` is the stream's watermark. Streams need
    the session setting PROVIDER."""
    if within <= timedelta(0):
        raise ValueError("the horizon must be longer than nothing")
    if unknown := [n for n in [*key, time, *fields] if n not in df.columns]:
        raise ValueError(f"the rows have no columns {unknown}")
    types = {f.name: f.dataType for f in df.schema.fields}
    span = within // timedelta(microseconds=1)
    if not df.isStreaming:
        return _on_table(_marked(df, time), df.columns, key, fields, span)
    df = _marked(df, time)
    packs = {f"p{i}": _packed(f) for i, f in enumerate(df.schema.fields) if f.name not in (AT, TIE)}
    names = dict(zip([n for n in df.columns if n not in (AT, TIE)], packs, strict=True))
    text = _key_text([packs[names[k]][1] for k in key], [packs[names[k]][0] for k in key])
    rows = df.select(AT, TIE, text.alias(KEY), *[c.alias(n) for n, (c, _) in packs.items()])
    # rows without a key are spread over all buckets
    hashed = F.when(F.col(KEY).isNotNull(), F.xxhash64(KEY)).otherwise(F.col(TIE))
    rows = rows.withColumn(BUCKET, F.pmod(hashed, F.lit(BUCKETS)).cast("int"))
    wanted = [names[f] for f in fields]
    shape = T.StructType([*[T.StructField(n, t) for n, (_, t) in packs.items()], T.StructField(SEEN, T.BooleanType()), *[T.StructField(f"b{i}", packs[w][1]) for i, w in enumerate(wanted)]])
    tables = rows.mapInArrow(_pack, f"{BUCKET} int, {AT} bigint, {ROWS} binary")
    tables = tables.select(F.timestamp_micros(AT).alias("__time"), BUCKET, ROWS).withWatermark("__time", late)
    gone = tables.groupBy(BUCKET).transformWithState(_Before(list(packs), wanted, span), f"{ROWS} binary", "append", "eventTime")
    made = gone.mapInArrow(_unpack, shape)
    own = [_unpacked(F.col(p), types[n]).alias(n) for n, p in names.items()]
    return made.select(*own, SEEN, *[_unpacked(F.col(f"b{i}"), types[f]).alias(BEFORE + f) for i, f in enumerate(fields)])


def _on_table(df: DataFrame, columns: list[str], key: list[str], fields: list[str], span: int) -> DataFrame:
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & _q(k).isNotNull()
    # rows without a key are spread over groups of their own rather than put in one
    df = df.withColumn("__span", F.floor(F.col(AT) / F.lit(span)).cast("long")).withColumn("__lone", F.when(~keyed, F.col(TIE)))
    carried = F.struct(AT, TIE, *[_q(f).alias(f"f{i}") for i, f in enumerate(fields)])
    keys = [f"__k{i}" for i in range(len(key))]
    df = df.withColumns({n: _q(k) for n, k in zip(keys, key, strict=True)})
    ends = df.where(keyed).groupBy(*keys, (F.col("__span") + 1).alias("__span")).agg(F.max_by(carried, F.struct(AT, TIE)).alias("__end"))
    inside = Window.partitionBy(*keys, "__lone", "__span").orderBy(AT, TIE)
    df = df.withColumn("__here", F.lag(carried).over(inside)).join(ends, [*keys, "__span"], "left")
    before = F.coalesce("__here", "__end")
    df = df.withColumn("__b", F.when(keyed & (F.col(AT) - before[AT] <= span), before))
    return df.select(*[_q(c) for c in columns], F.col("__b").isNotNull().alias(SEEN), *[F.col("__b")[f"f{i}"].alias(BEFORE + f) for i, f in enumerate(fields)])


def wanted_before(checker: Checker, schema: str) -> list[str]:
    """The fields whose previous values the rules of a schema read."""
    checked, _ = rules_of(checker.schemas[schema])
    nodes = [n for r in checked for x in (r.node, r.condition) if x is not None for n in S.walk(x)]
    return sorted({constant(n.args, 0) for n in nodes if isinstance(n, S.Call) and n.name == "previous"})


def _previous(args, scope: Scope) -> Value:
    return scope.fields.get(BEFORE + constant(args, 0), literal(None))


def running_errors(df: DataFrame, source: str, schema: str, key: list[str], time: str, within: timedelta, late: str = "10 minutes", keep: bool = False) -> DataFrame:
    """The rows that break a rule, with their ``errors``; rules may read ``previous("field")`` of the same key, whose values
    come out too if they are to be kept. Append mode."""
    checker = Checker(source)
    rows = with_previous(df, key, time, wanted_before(checker, schema), within, late)
    found = checker.rows(rows, schema, functions={"previous": _previous}).where(F.size("errors") > 0)
    return found if keep else found.select(*[_q(c) for c in df.columns], "errors")


def repeats(df: DataFrame, source: str, schema: str, time: str, within: timedelta, late: str = "10 minutes") -> DataFrame:
    """The rows that repeat a value of a field marked ``unique`` no later than ``within`` after it stood last, with ``field``;
    a row for each such field. Nulls repeat nothing. Append mode."""
    fields = [f.name for f in Checker(source).schemas[schema].fields if f.unique and f.name in df.columns]
    if not fields:
        raise ValueError(f"schema {schema!r} has no unique field that the rows hold")
    found = None
    for f in fields:
        one = with_previous(df, [f], time, [], within, late).where(SEEN).drop(SEEN).withColumn("field", F.lit(f))
        found = one if found is None else found.unionByName(one)
    return found


def first_of_each(df: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A stream with rows of equal ``keys`` once, as long as copies come no later than ``late`` after each other; the state
    holds the keys of that span alone."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
