"""Values that run on from row to row, by row number, without putting a table in one order or in one task.

Rows are cut by number into chunks of CHUNK. Where what a chunk does to the value handed to it can be said in short (it adds a
sum; it multiplies and adds; it adds and stops at a bound), chunks are summed up at the same time, the few summaries are run through in order, by the
same means if they are many, and each chunk then starts from the value handed to it. Anything else is stepped through
chunk by chunk, one job each, and only the last row's values are handed on. No task ever holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans import syntax as S
from ..workspace import folder

#: Rows of a chunk, and of a block in it: arrays grow by copying, so long ones are built of blocks.
CHUNK, BLOCK = 40_000, 200
_G, _ROWS, _BEFORE = "__chunk", "__rows", "__before"


def before_each(df: DataFrame, number: str, value: Column, rows: int, out: str = _BEFORE) -> DataFrame:
    """``df`` with the sum of ``value`` (null counts as nothing) over all rows of smaller ``number``, which are unique and
    stand from 0 to ``rows``."""
    size = F.coalesce(value, F.lit(0))
    df = df.withColumn("__v", size).withColumn(_G, F.floor(F.col(number) / CHUNK).cast("long"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy(_G).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(df.schema["__v"].dataType))
    if rows <= CHUNK:
        return df.withColumn(out, inside).drop("__v", _G)
    sums = df.groupBy(F.col(_G).alias("__n")).agg(F.sum("__v").alias("__sum"))
    starts = before_each(sums, "__n", F.col("__sum"), -(-rows // CHUNK), "__from").select(F.col("__n").alias("__g"), F.col("__from").alias("__start"))
    df = df.withColumn(out, inside).join(starts, F.col(_G) == F.col("__g"))
    return df.withColumn(out, F.col(out) + F.col("__start")).drop("__v", _G, "__g", "__start")


def numbered(df: DataFrame, by: str | None = None, out: str = "_row") -> DataFrame:
    """``df`` with gapless numbers from 0: in the order of a whole-number column, equal values in any fixed order of the other
    columns; or, without one, in an order that a hash of the rows decides. Rows are counted in groups, the groups' counts
    are summed up in order, and rows are ordered within their group alone."""
    simple = [c.name for c in df.schema.fields if c.name != by and not isinstance(c.dataType, T.MapType | T.VariantType)]
    low, high, rows = df.agg(F.min(by) if by else F.lit(0), F.max(by) if by else F.lit(0), F.count(F.lit(1))).first()
    if by:
        width = max(1, (high - low + 1) * CHUNK // max(rows, 1)) if rows else 1
        group = F.coalesce(F.expr(f"(`{by}` - {low}) div {width}"), F.lit(0)).cast("long") if rows else F.lit(0).cast("long")
        groups, order = ((high - low) // width + 1 if rows else 1), [F.col(f"`{by}`"), *[F.col(f"`{c}`") for c in simple]]
    else:
        groups = max(1, -(-rows // CHUNK))
        row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in simple])
        group, order = F.pmod(row_hash, F.lit(groups)), [row_hash, *[F.col(f"`{c}`") for c in simple]]
    df = df.withColumn("__part", group)
    sums = df.groupBy(F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    starts = before_each(sums, "__of", F.col("__size"), groups, "__first").select("__of", "__first")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return df.withColumn(out, rank).join(starts, F.col("__part") == F.col("__of")).withColumn(out, F.col(out) + F.col("__first")).drop("__part", "__of", "__first")


def stepped(rows: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of the rows (an array of structs), from a start on."""
    n = F.size(rows)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, BLOCK))
    state = lambda last, done: F.struct(last.alias("last"), done.alias("done"))
    none = F.slice(F.array(start), 1, 0)

    def row(s: Column, r: Column) -> Column:
        # one element stands for the step's result, so that it is computed once
        made = F.array(step(s["last"], r))
        return F.element_at(F.transform(made, lambda x: state(x, F.concat(s["done"], F.array(x)))), 1)

    def block(s: Column, b: Column) -> Column:
        inner = F.array(F.aggregate(b, state(s["last"], none), row))
        return F.element_at(F.transform(inner, lambda x: state(x["last"], F.concat(s["done"], F.array(x["done"])))), 1)

    return F.flatten(F.aggregate(blocks, state(start, F.slice(F.array(none), 1, 0)), block)["done"])


def _gathered(df: DataFrame, number: str, by: Column) -> DataFrame:
    row = F.struct(F.col(number), *[F.col(f"`{c}`") for c in df.columns if c != number])
    # numbers differ, so no other column is compared; maps could not be
    in_order = F.array_sort(F.collect_list(row), lambda a, b: F.when(a[number] < b[number], -1).when(a[number] > b[number], 1).otherwise(0))
    return df.groupBy(by.alias(_G)).agg(in_order.alias(_ROWS))


@dataclass(frozen=True)
class Law:
    """A kind of maps of one value that compose to maps of the same kind: their columns, the map that changes nothing, what
    a map makes of a value, and one map after another."""

    unit: dict[str, float]
    after: Callable[[Column, Column], Column]
    then: Callable[[Column, Column], dict[str, Column]]


#: The value times ``rate`` plus ``add``.
AFFINE = Law({"rate": 1.0, "add": 0.0}, lambda s, r: s * r["rate"] + r["add"], lambda s, r: {"rate": s["rate"] * r["rate"], "add": s["add"] * r["rate"] + r["add"]})


def bounded(low: bool) -> Law:
    """The value plus ``add``, but no less than ``bound`` (or, if not ``low``, no more). Null bounds nothing."""
    pick = F.greatest if low else F.least
    return Law({"add": 0.0, "bound": None}, lambda s, r: pick(s + r["add"], r["bound"]), lambda s, r: {"add": s["add"] + r["add"], "bound": pick(s["bound"] + r["add"], r["bound"])})


def _struct(cols: dict[str, Column], kind: T.DataType) -> Column:
    return F.struct(*[c.cast(kind).alias(n) for n, c in cols.items()])


def affine(df: DataFrame, number: str, rate: Column, add: Column, rows: int, out: str) -> DataFrame:
    """``df`` with ``out``: the value of the row before times ``rate`` plus ``add``, from 0 on. Such maps compose to maps of
    the same kind, so a chunk is summed up by one."""
    return mapped(df, number, AFFINE, {"rate": rate, "add": add}, rows, out)


def mapped(df: DataFrame, number: str, law: Law, maps: dict[str, Column], rows: int, out: str) -> DataFrame:
    """``df`` with ``out``: what each row's map makes of the value of the row before, from 0 on."""
    slim = df.select(number, *[c.alias(n) for n, c in maps.items()])
    kind = T.LongType() if all(isinstance(slim.schema[c].dataType, T.IntegralType) for c in maps) else T.DoubleType()
    slim = slim.select(number, *[F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c) for c in maps])
    seen = _mapped(slim, number, law, rows, kind).select(F.col(number).alias("__at"), F.col("after").alias(out))
    return df.join(seen, F.col(number) == F.col("__at")).drop("__at")


def _mapped(slim: DataFrame, number: str, law: Law, rows: int, kind: T.DataType) -> DataFrame:
    """number, and the value after it."""
    zero = F.lit(0).cast(kind)
    if rows <= CHUNK:
        chunks = _gathered(slim, number, F.lit(0)).withColumn("__start", zero)
    else:
        chunks = _gathered(slim, number, F.floor(F.col(number) / CHUNK).cast("long"))
        whole = F.aggregate(_ROWS, _struct({n: F.lit(x) for n, x in law.unit.items()}, kind), lambda s, r: _struct(law.then(s, r), kind))
        sums = chunks.select(F.col(_G).alias("__n"), whole.alias("m")).select("__n", "m.*")
        ends = _mapped(sums, "__n", law, -(-rows // CHUNK), kind).select((F.col("__n") + 1).alias("__g"), F.col("after").alias("__start"))
        chunks = chunks.join(ends, F.col(_G) == F.col("__g"), "left").withColumn("__start", F.coalesce("__start", zero))
    pairs = F.arrays_zip(F.col(_ROWS).getField(number).alias("n"), stepped(F.col(_ROWS), F.col("__start"), law.after).alias("after"))
    return chunks.select(F.explode(pairs).alias("p")).select(F.col("p.n").alias(number), F.col("p.after").alias("after"))


def in_turn(df: DataFrame, number: str, rows: int, kind: T.StructType, step: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with the fields of ``kind``: of each row, what ``step`` makes of those of the row before (all null before the
    first) and of the row itself. Steps of any kind can't be taken at the same time, so chunks are written in turn."""

    def states(part: DataFrame, start: Column) -> DataFrame:
        made = stepped(F.col(_ROWS), start, lambda s, r: step(s, r).cast(kind))
        pairs = F.arrays_zip(F.col(_ROWS).alias("row"), made.alias("state"))
        part = _gathered(part, number, F.lit(0)).select(F.explode(pairs).alias("p"))
        kept = [c for c in df.columns if c not in kind.names]
        return part.select(*[F.col("p.row").getField(c).alias(c) for c in kept], *[F.col("p.state").getField(c).alias(c) for c in kind.names])

    start = F.lit(None).cast(kind)
    if rows <= CHUNK:
        return states(df, start)
    at, spark = folder(df.sparkSession, "in-turn"), df.sparkSession
    schema = None
    # each job reads the rows of its own chunk alone
    cut = df.withColumn(_G, F.floor(F.col(number) / CHUNK).cast("long"))
    cut.repartition(_G).write.partitionBy(_G).parquet(f"{at}-rows")
    for c in range(-(-rows // CHUNK)):
        out = states(spark.read.schema(df.schema).parquet(f"{at}-rows/{_G}={c}"), start)
        schema = out.schema
        out.write.parquet(f"{at}/chunk={c}")
        last = spark.read.schema(schema).parquet(f"{at}/chunk={c}").where(F.col(number) == (c + 1) * CHUNK - 1)
        last = last.select(F.to_json(F.struct(*kind.names), {"ignoreNullFields": "false"}).alias("j")).first()
        start = F.from_json(F.lit(last["j"]), kind) if last else start
    return spark.read.schema(schema).parquet(f"{at}/chunk=*")


# -- what an expression does to the value before

Hole = Callable[[S.Node], bool]


def previous_of(name: str) -> Hole:
    """Tells whether a node is the previous value of ``name``."""
    return lambda n: isinstance(n, S.Call) and n.name == "previous" and bool(n.args) and isinstance(n.args[0], S.Literal) and n.args[0].value == name


def linear(node: S.Node, hole: Hole) -> tuple[S.Node, S.Node] | None:
    """Rate and addition, as expressions, of a node that multiplies one value, which ``hole`` knows, and adds to it; None if it
    does anything else to it. Conditions may ask whether there is a previous value at all."""
    zero, one = S.Literal(0), S.Literal(1)
    reads = lambda n: any(hole(x) for x in S.walk(n))
    both = lambda op, a, b: a if b == zero else S.Binary(op, a, b)
    if hole(node):
        return one, zero
    if not reads(node):
        return zero, node
    match node:
        case S.Unary(op, x) if (m := linear(x, hole)) is not None:
            return m if op == "+" else (S.Unary("-", m[0]), S.Unary("-", m[1]))
        case S.Binary(op, x, y) if op in ("+", "-"):
            a, b = linear(x, hole), linear(y, hole)
            if a is not None and b is not None:
                add = b[1] if a[1] == zero and op == "+" else both(op, a[1], b[1])
                rate = b[0] if a[0] == zero and op == "+" else both(op, a[0], b[0])
                return rate, add
        case S.Binary("*", x, y):
            x, y = (y, x) if reads(y) else (x, y)
            if not reads(y) and (a := linear(x, hole)) is not None and (a[1] == zero or _same(y)):
                return (y if a[0] == one else S.Binary("*", a[0], y)), (zero if a[1] == zero else S.Binary("*", a[1], y))
        case S.Binary("/", x, S.Literal(by)) if isinstance(by, int | float) and by and (a := linear(x, hole)) is not None:
            return S.Binary("/", a[0], S.Literal(by)), S.Binary("/", a[1], S.Literal(by))
        case S.Ternary(condition, yes, no):
            asked = _asks(condition, hole)
            if asked is not None:  # every row but the first has a previous value
                return linear(no if asked else yes, hole)
            a, b = linear(yes, hole), linear(no, hole)
            if not reads(condition) and _same(condition) and a is not None and b is not None:
                return S.Ternary(condition, a[0], b[0]), S.Ternary(condition, a[1], b[1])
    return None


def clamp(node: S.Node, hole: Hole) -> tuple[S.Node, float, bool] | None:
    """What a node adds to one value, which ``hole`` knows, where it stops, and whether that is its least value (or its
    greatest): choices between a sum and the number that it is compared with. None if it does anything else."""
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    if not isinstance(node, S.Ternary) or not isinstance(node.condition, S.Binary) or node.condition.op not in turned:
        return None
    op, x, y = node.condition.op, node.condition.left, node.condition.right
    if _number(x) is not None:
        op, x, y = turned[op], y, x
    bound, branches = _number(y), [node.yes, node.no]
    if bound is None or x not in branches or y not in branches or not _same_but(x, hole):
        return None
    parts = linear(x, hole)
    if parts is None or parts[0] != S.Literal(1):
        return None
    # x < y ? y : x is the greater of both, and so is x > y ? x : y
    return parts[1], bound, (op in ("<", "<=")) == (node.yes == y)


def _number(node: S.Node) -> int | float | None:
    match node:
        case S.Literal(int() | float() as value) if not isinstance(value, bool):
            return value
        case S.Unary("-", S.Literal(int() | float() as value)) if not isinstance(value, bool):
            return -value
    return None


def _same_but(node: S.Node, hole: Hole) -> bool:
    """Whether a node reads the value once, and all else in it gives the same each time."""
    inside = list(S.walk(node))
    return sum(map(hole, inside)) == 1 and not any(isinstance(n, S.Choice | S.Cycle | S.Draw | S.Range | S.Call) and not hole(n) for n in inside)


def _same(node: S.Node) -> bool:
    """Whether a node gives the same each time it is computed: it draws nothing and calls nothing that might."""
    return not any(isinstance(n, S.Choice | S.Cycle | S.Draw | S.Range | S.Call) for n in S.walk(node))


def _asks(node: S.Node, hole: Hole) -> bool | None:
    """True for "there is no previous value", False for "there is one", None for anything else."""
    match node:
        case S.Not(x):
            inner = _asks(x, hole)
            return None if inner is None else not inner
        case S.Binary("==", S.Call("previous", _) as c, S.Literal(None)) | S.Binary("==", S.Literal(None), S.Call("previous", _) as c) if hole(c):
            return True
    return None


# -- maps of one value by group


def compose(first: tuple[Column, Column], then: tuple[Column, Column]) -> tuple[Column, Column]:
    """Rate and addition of one map after another."""
    return first[0] * then[0], first[1] * then[0] + then[1]


def composed(df: DataFrame, group: str, number: str, names: list[str], law: Law = AFFINE) -> DataFrame:
    """For each group, the maps (``<name>_rate`` and ``<name>_add``, or the law's other columns) of its rows composed in the
    order of ``number``, for each of ``names``. A group of any size is composed by chunks of row numbers first, so none of it
    comes together in one task."""
    cols = {f"{n}_{x}": value for n in names for x, value in law.unit.items()}
    kind = T.DoubleType()
    start = _struct({c: F.lit(value) for c, value in cols.items()}, kind)

    def step(s: Column, r: Column) -> Column:
        of = lambda x, n: {c: x[f"{n}_{c}"] for c in law.unit}
        return _struct({f"{n}_{c}": made for n in names for c, made in law.then(of(s, n), of(r, n)).items()}, kind)

    df = df.select(group, F.col(number).alias("__n"), *[F.col(c).cast(kind).alias(c) for c in cols])
    left = (df.agg(F.max("__n")).first()[0] or 0) + 1
    while True:
        left = -(-left // CHUNK)
        rows = F.sort_array(F.collect_list(F.struct("__n", *cols)))
        df = df.groupBy(group, F.floor(F.col("__n") / CHUNK).alias("__c")).agg(F.aggregate(rows, start, step).alias("m")).select(group, F.col("__c").alias("__n"), "m.*")
        if left <= 1:
            return df.drop("__n")
