"""From expressions to Spark columns.

``Scope`` says what names mean where an expression stands; ``compiled`` turns a node into a ``Value``. Everything becomes
one column expression, so Catalyst sees the whole of it and generates code for it; no Python runs on a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from . import values as V
from .values import Value

Registry = dict[str, Callable]


class CompileError(ValueError):
    """An expression that has no meaning."""


@dataclass
class Scope:
    """``fields``: the row's own values by name. ``item``: the element under test in a predicate, whose fields come
    first. ``parent``: the scope around a nested collection. ``lets``: expressions by name, put in where they are used.
    ``draw``: gives a new uniform column in [0, 1) at each call, or None where nothing may be drawn. ``extra``: functions
    that this place adds (aggregates of whole tables, references)."""

    fields: dict[str, Value] = field(default_factory=dict)
    parent: Scope | None = None
    lets: dict[str, S.Node] = field(default_factory=dict)
    draw: Callable[[str], Column] | None = None
    functions: Registry = field(default_factory=dict)
    special: Callable[[S.Node, Scope], Value | None] | None = None
    used: set[str] = field(default_factory=set)

    def inside(self, item: Value) -> Scope:
        """The scope of a predicate over ``item``."""
        names = {f.name: Value(item.column.getField(f.name), f.dataType) for f in item.type.fields} if isinstance(item.type, T.StructType) else {}
        return replace(self, fields=names)

    def uniform(self, label: str) -> Column:
        if self.draw is None:
            raise CompileError(f"nothing can be drawn here ({label})")
        return self.draw(label)


def row_scope(schema: T.StructType, lets: dict[str, S.Node] | None = None, functions: Registry | None = None, prefix: Column | None = None) -> Scope:
    """The scope of a DataFrame's rows."""
    from .builtins import REGISTRY

    get = lambda n: F.col("`" + n.replace("`", "``") + "`") if prefix is None else prefix.getField(n)
    return Scope({f.name: Value(get(f.name), f.dataType) for f in schema.fields}, lets=lets or {}, functions=REGISTRY | (functions or {}))


def member(v: Value, name: str) -> Value:
    """A field of a struct; of an array, the fields of its elements, those that are null left out."""
    if isinstance(v.type, T.StructType):
        for f in v.type.fields:
            if f.name == name:
                return Value(v.column.getField(name), f.dataType)
        return V.literal(None)
    if isinstance(v.type, T.ArrayType):
        one = member(Value(F.lit(None), v.type.elementType), name)
        if one.kind == "null":
            return Value(F.filter(F.array(), lambda x: F.lit(False)), T.ArrayType(T.NullType()))
        inner = F.transform(v.column, lambda x: member(Value(x, v.type.elementType), name).column)
        return Value(F.filter(inner, lambda x: x.isNotNull()), T.ArrayType(one.type))
    return V.literal(None)


def resolved(parts: tuple[str, ...], scope: Scope) -> Value:
    head = parts[0]
    scope.used.add(head)
    if head in scope.lets and head not in scope.fields:
        v = compiled(scope.lets[head], scope)
    elif head in scope.fields:
        v = scope.fields[head]
    else:
        return V.literal(None)
    for p in parts[1:]:
        v = member(v, p)
    return v


def branches(pairs: list[tuple[Column | None, Value]], error: Column | None = None) -> Value:
    """The value of the first condition that holds; None stands for otherwise."""
    t = V.common([v.type for _, v in pairs])
    out, failed = None, None
    for condition, v in pairs:
        if condition is None:
            out = V.to(v, t) if out is None else out.otherwise(V.to(v, t))
        else:
            out = F.when(condition, V.to(v, t)) if out is None else out.when(condition, V.to(v, t))
    if any(v.error is not None for _, v in pairs):
        for condition, v in pairs:
            e = v.error if v.error is not None else F.lit(False)
            if condition is None:
                failed = e if failed is None else failed.otherwise(e)
            else:
                failed = F.when(condition, e) if failed is None else failed.when(condition, e)
        failed = F.coalesce(failed, F.lit(False))
    return Value(out, t, V.errors(error, failed))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op in "+-" and b.kind == "duration":
        return moved(a, b, op)
    if op in "+-" and a.kind == "duration" and op == "+":
        return moved(b, a, op)
    error = V.errors(a, b)
    if op == "/":
        x, y = V.number(a), V.number(b)
        return Value(F.try_divide(x, y), T.DoubleType(), V.errors(error, y == 0))
    if a.whole and b.whole:
        x, y = (F.coalesce(v.column.cast("long"), F.lit(0).cast("long")) for v in (a, b))
        return Value(x + y if op == "+" else x - y if op == "-" else x * y, T.LongType(), error)
    x, y = V.number(a), V.number(b)
    return Value(x + y if op == "+" else x - y if op == "-" else x * y, T.DoubleType(), error)


def moved(date: Value, by: Value, op: str) -> Value:
    """A date or date text plus or minus a duration; a day stays a day, anything finer is a moment in ISO form."""
    step = by.column if op == "+" else -by.column
    if isinstance(date.type, T.DateType):
        return Value((date.column.cast("timestamp") + step).cast("date"), T.DateType(), V.errors(date, by))
    if date.kind == "date":
        return Value(date.column + step, T.TimestampType(), V.errors(date, by))
    text = V.text(date)
    at = text.try_cast("timestamp") + step
    out = F.when(F.length(text) == 10, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return Value(out, T.StringType(), V.errors(date, by))


def compiled(node: S.Node, scope: Scope) -> Value:
    if scope.special is not None and (v := scope.special(node, scope)) is not None:
        return v
    go = lambda n: compiled(n, scope)
    match node:
        case S.Literal(value):
            return V.literal(value)
        case S.Path(parts):
            return resolved(parts, scope)
        case S.Parent(parts):
            return resolved(parts, scope.parent) if scope.parent else V.literal(None)
        case S.Unary(op, operand):
            v = go(operand)
            if v.whole:
                c = F.coalesce(v.column.cast("long"), F.lit(0).cast("long"))
                return Value(-c if op == "-" else c, T.LongType(), v.error)
            return Value(-V.number(v) if op == "-" else V.number(v), T.DoubleType(), v.error)
        case S.Binary("==", left, right):
            a, b = go(left), go(right)
            return Value(V.equal(a, b), T.BooleanType(), V.errors(a, b))
        case S.Binary(op, left, right) if op in ("<", ">", "<=", ">="):
            a, b = go(left), go(right)
            return Value(V.compared(op, a, b), T.BooleanType(), V.errors(a, b))
        case S.Binary(op, left, right):
            return arithmetic(op, go(left), go(right))
        case S.Logical(op, left, right):
            a, b = go(left), go(right)
            x, y = V.truth(a), V.truth(b)
            late = b.error if b.error is None else (b.error & x if op == "and" else b.error & ~x)
            return Value(x & y if op == "and" else x | y, T.BooleanType(), V.errors(a, late))
        case S.Not(operand):
            v = go(operand)
            return Value(~V.truth(v), T.BooleanType(), v.error)
        case S.Ternary(condition, yes, no):
            c = go(condition)
            return branches([(V.truth(c), go(yes)), (None, go(no))], c.error)
        case S.Match(value, arms):
            v = go(value)
            pairs = [(V.equal(v, go(pattern)), go(result)) for pattern, result in arms]
            return branches([*pairs, (None, V.literal(None))], v.error)
        case S.Choice(options):
            return chosen(options, scope)
        case S.Cycle(elements):
            return chosen(tuple((None, e) for e in elements), scope)
        case S.Range(low, high):
            return drawn(S.Draw("int", None, node), scope) if high is not None else go(low)
        case S.Draw():
            return drawn(node, scope)
        case S.Call(name, args):
            return called(name, args, scope)
    raise CompileError(f"{type(node).__name__} has no meaning here")


def chosen(options: tuple, scope: Scope) -> Value:
    """One of the options: a weight is its share, and those without one divide what is left of 1."""
    u = scope.uniform("choice")
    given = sum(w for w, _ in options if w is not None)
    bare = sum(w is None for w, _ in options)
    share = max(0.0, 1 - given) / bare if bare else 0.0
    total = given + share * bare
    at, pairs = 0.0, []
    for k, (w, node) in enumerate(options):
        at += share if w is None else w
        pairs.append((None if k == len(options) - 1 else u * total < at, compiled(node, scope)))
    return branches(pairs)


def drawn(node: S.Draw, scope: Scope) -> Value:
    """A primitive type: a value drawn from its range, both ends included."""
    low, high = (compiled(x, scope) if x is not None else None for x in ((node.within.low, node.within.high) if node.within else (None, None)))
    u = scope.uniform(node.kind)
    if node.kind == "boolean":
        return Value(u > 0.5, T.BooleanType())
    if node.kind == "string":
        from .builtins import word

        return Value(word(u), T.StringType())
    if node.kind == "date":
        if low is None:
            first, days = F.lit("2020-01-01").cast("date"), F.datediff(F.current_date(), F.lit("2020-01-01").cast("date")) + 1
        else:
            first = _day(low, 1)
            days = F.datediff(_day(high, 12), first) + 1
        return Value(F.date_add(first, F.floor(u * days).cast("int")), T.DateType())
    a = V.number(low) if low else F.lit(0.0)
    if node.kind == "int":
        b = V.number(high) if high else F.lit(1000.0 if node.within else 999.0)
        low_, high_ = F.least(a, b), F.greatest(a, b)
        return Value((F.floor(u * (high_ - low_ + 1)) + low_).cast("long"), T.LongType())
    b = V.number(high) if high else F.lit(1000.0)
    x = u * (b - a) + a
    places = node.precision if node.precision is not None else None if node.within else 2
    return Value(x if places is None else V.js_round(x, places), T.DoubleType())


def _day(v: Value, month: int) -> Column:
    """A year's first (month 1) or last day (month 12), or the day of an ISO text."""
    if v.kind == "number":
        return F.make_date(v.column.cast("int"), F.lit(month), F.lit(1 if month == 1 else 31))
    return V.text(v).try_cast("date")


def called(name: str, args: tuple[S.Node, ...], scope: Scope) -> Value:
    found = scope.functions.get(name) or scope.functions.get(f"faker.{name}") or next((f for k, f in scope.functions.items() if k.split(".", 1)[-1] == name and "." in k), None)
    if found is None:
        raise CompileError(f"unknown function {name!r}")
    return found(args, scope)
