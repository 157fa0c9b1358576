"""The functions of expressions, by name: each takes the argument nodes and the scope and gives a ``Value``."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from . import values as V
from .values import Value

REGISTRY: dict = {}

STRING, DOUBLE, LONG, BOOLEAN = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def function(*names: str):
    """Registers a function of compiled arguments."""

    def put(f):
        @wraps(f)
        def call(args, scope):
            from .compiler import compiled

            values = [compiled(a, scope) for a in args]
            out = f(values, scope)
            out.error = V.errors(*values, out.error)
            return out

        for n in names:
            REGISTRY[n] = call
        return f

    return put


def special(*names: str):
    """Registers a function of argument nodes."""

    def put(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def arg(values: list[Value], i: int) -> Value:
    return values[i] if i < len(values) else V.literal(None)


def constant(args: tuple[S.Node, ...], i: int, default=None):
    """The value of a literal argument."""
    if i < len(args) and isinstance(args[i], S.Literal):
        return args[i].value
    return default


# -- aggregates of an array


def _numbers(v: Value) -> Column:
    """The numbers of an array as doubles; empty for anything else."""
    if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.NumericType):
        return F.coalesce(F.filter(v.column.cast("array<double>"), lambda x: x.isNotNull()), F.array().cast("array<double>"))
    return F.array().cast("array<double>")


def _or_zero(c: Column) -> Value:
    return Value(F.coalesce(c, F.lit(0.0)), DOUBLE)


@function("sum")
def _sum(values, scope):
    return _or_zero(F.aggregate(_numbers(arg(values, 0)), F.lit(0.0), lambda a, x: a + x))


@function("count")
def _count(values, scope):
    v = arg(values, 0)
    return Value(F.coalesce(F.when(v.column.isNotNull(), F.size(v.column)), F.lit(0)).cast("long") if v.kind == "array" else F.lit(0).cast("long"), LONG)


def _extreme(values: list[Value], one, many) -> Value:
    if values and values[0].kind == "array":
        return _or_zero(one(_numbers(values[0])))
    numbers = [F.coalesce(v.column.cast("double"), V.null_of(DOUBLE)) for v in values if v.kind == "number"]
    return _or_zero(numbers[0] if len(numbers) == 1 else many(*numbers)) if numbers else Value(F.lit(0.0), DOUBLE)


@function("min")
def _min(values, scope):
    return _extreme(values, F.array_min, F.least)


@function("max")
def _max(values, scope):
    return _extreme(values, F.array_max, F.greatest)


@function("avg")
def _avg(values, scope):
    a = _numbers(arg(values, 0))
    return _or_zero(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)))


@function("product")
def _product(values, scope):
    a = _numbers(arg(values, 0))
    return Value(F.when(F.size(a) > 0, F.aggregate(a, F.lit(1.0), lambda s, x: s * x)).otherwise(0.0), DOUBLE)


@function("median")
def _median(values, scope):
    a = F.sort_array(_numbers(arg(values, 0)))
    n = F.size(a)
    at = lambda i: F.try_element_at(a, F.greatest(i, F.lit(1)).cast("int"))
    return _or_zero((at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def _end(values: list[Value], i: int) -> Value:
    v = arg(values, 0)
    return Value(F.try_element_at(v.column, F.lit(i)), v.type.elementType) if v.kind == "array" else V.literal(None)


@function("first")
def _first(values, scope):
    return _end(values, 1)


@function("last")
def _last(values, scope):
    return _end(values, -1)


# -- predicates over an array


def _predicate(args, scope):
    from .compiler import compiled

    v = compiled(args[0], scope)
    if v.kind != "array":
        return None, None
    return v, lambda x: V.truth(compiled(args[1], scope.inside(Value(x, v.type.elementType))))


@special("all")
def _all(args, scope):
    v, p = _predicate(args, scope)
    return Value(F.coalesce(F.forall(v.column, p), F.lit(True)) if v else F.lit(True), BOOLEAN)


@special("some")
def _some(args, scope):
    v, p = _predicate(args, scope)
    return Value(F.coalesce(F.exists(v.column, p), F.lit(False)) if v else F.lit(False), BOOLEAN)


@special("none")
def _none(args, scope):
    v, p = _predicate(args, scope)
    return Value(~F.coalesce(F.exists(v.column, p), F.lit(False)) if v else F.lit(True), BOOLEAN)


# -- numbers


def _places(values: list[Value]) -> Column:
    return V.strict_number(arg(values, 1), 0)


@function("round")
def _round(values, scope):
    return Value(V.js_round(V.strict_number(arg(values, 0), 0), _places(values)), DOUBLE)


@function("floor")
def _floor(values, scope):
    f = F.pow(F.lit(10.0), _places(values))
    return Value(F.floor(V.strict_number(arg(values, 0), 0) * f) / f, DOUBLE)


@function("ceil")
def _ceil(values, scope):
    f = F.pow(F.lit(10.0), _places(values))
    return Value(F.ceil(V.strict_number(arg(values, 0), 0) * f) / f, DOUBLE)


# -- strings


def _string(name: str, build) -> None:
    @function(name)
    def call(values, scope):
        return Value(build(*[V.text(v) for v in values]), STRING)


_string("uppercase", F.upper)
_string("lowercase", F.lower)
_string("trim", lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
_string("capitalize", lambda s: F.array_join(F.transform(F.split(s, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), " "))
_string("kebabCase", lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1-$2"), r"[\s_]+", "-")))
_string("snakeCase", lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1_$2"), r"[\s-]+", "_")))


def _camel(s: Column) -> Column:
    parts = F.split(s, r"[-_\s]+", -1)
    upper = F.transform(parts, lambda w, i: F.when(i > 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))).otherwise(w))
    joined = F.array_join(upper, "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 2**31 - 1))


_string("camelCase", _camel)


@function("concat")
def _concat(values, scope):
    return Value(F.concat(*[V.text(v) for v in values]) if values else F.lit(""), STRING)


@function("substring")
def _substring(values, scope):
    s = V.text(arg(values, 0))
    n = F.length(s)
    cut = lambda c: F.least(F.greatest(c.cast("int"), F.lit(0)), n)
    a = cut(V.strict_number(arg(values, 1), 0))
    b = cut(V.strict_number(values[2], 0)) if len(values) > 2 and values[2].kind != "null" else n
    return Value(F.substr(s, F.least(a, b) + 1, F.abs(b - a)), STRING)


@function("replace")
def _replace(values, scope):
    s, find, by = (V.text(arg(values, i)) for i in range(3))
    at = F.call_function("locate", find, s)
    return Value(F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), by, F.substr(s, at + F.length(find), F.length(s)))).otherwise(s), STRING)


@function("length")
def _length(values, scope):
    return Value(F.length(V.text(arg(values, 0))).cast("long"), LONG)


# -- dates


def _moment(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@function("now")
def _now(values, scope):
    return Value(_moment(F.current_timestamp()), STRING)


@function("today")
def _today(values, scope):
    return Value(F.date_format(F.current_date(), "yyyy-MM-dd"), STRING)


@function("daysAgo")
def _days_ago(values, scope):
    return Value(V.day_text(F.date_sub(F.current_date(), V.strict_number(arg(values, 0), 0).cast("int"))), STRING)


@function("daysFromNow")
def _days_from_now(values, scope):
    return Value(V.day_text(F.date_add(F.current_date(), V.strict_number(arg(values, 0), 0).cast("int"))), STRING)


def _instant(v: Value, last: bool) -> Column:
    if v.kind == "number":
        day = F.make_date(v.column.cast("int"), F.lit(12 if last else 1), F.lit(31 if last else 1)).cast("timestamp")
        return day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") if last else day
    if v.kind == "null":
        return F.current_timestamp() if last else F.lit("2020-01-01").cast("timestamp")
    return F.when(V.text(v) == "today", F.current_timestamp()).otherwise(V.text(v).try_cast("timestamp"))


@function("datetime")
def _datetime(values, scope):
    a, b = _instant(arg(values, 0), False), _instant(arg(values, 1), True)
    lo, hi = F.unix_millis(a), F.unix_millis(b)
    return Value(_moment(F.timestamp_millis(lo + F.floor(scope.uniform("datetime") * (hi - lo)))), STRING)


@function("dateBetween")
def _date_between(values, scope):
    a, b = _instant(arg(values, 0), False).cast("date"), _instant(arg(values, 1), True).cast("date")
    return Value(V.day_text(F.date_add(a, F.floor(scope.uniform("date") * (F.datediff(b, a) + 1)).cast("int"))), STRING)


@special("formatDate")
def _format_date(args, scope):
    from .compiler import compiled

    v, form = compiled(args[0], scope), constant(args, 1, "YYYY-MM-DD")
    at = v.column.cast("timestamp") if v.kind == "date" else V.text(v).try_cast("timestamp")
    out = F.lit(form)
    for mark, pattern in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss")):
        i = form.find(mark)
        if i >= 0:
            out = F.regexp_replace(out, f"^(.{{{i}}}){mark}", F.concat(F.lit("$1"), F.date_format(at, pattern)))
    return Value(out, STRING, v.error)


#: Days of the fixed-length units.
for _name, _hours in (("days", 24), ("weeks", 168), ("months", 720), ("years", 8760), ("hours", 1)):

    def _duration(values, scope, hours=_hours):
        return Value(F.make_dt_interval(F.lit(0), (V.strict_number(arg(values, 0), 0) * hours).cast("int"), F.lit(0), F.lit(0.0).cast("decimal(18,6)")), T.DayTimeIntervalType())

    function(f"date.{_name}")(_duration)


@function("date.minutes")
def _minutes(values, scope):
    return Value(F.make_dt_interval(F.lit(0), F.lit(0), V.strict_number(arg(values, 0), 0).cast("int"), F.lit(0.0).cast("decimal(18,6)")), T.DayTimeIntervalType())


def _weekdays(values: list[Value], scope, allowed: list[int]) -> Value:
    """A day whose number (0 for Sunday) is allowed: weeks from the first day on, then a day of the week."""
    a, b = _instant(arg(values, 0), False).cast("date"), _instant(arg(values, 1), True).cast("date")
    days = F.datediff(b, a) + 1
    start = F.dayofweek(a) - 1
    marks = F.array(*[F.lit(d) for d in allowed])
    # offsets of the allowed days of the first week; whole weeks are added
    offset = F.array_sort(F.transform(marks, lambda d: F.pmod(d - start, F.lit(7))))
    per = len(allowed)
    full = F.floor(days / 7) * per + F.size(F.filter(offset, lambda o: o < F.pmod(days, F.lit(7))))
    k = F.floor(scope.uniform("weekday") * F.greatest(full, F.lit(1)))
    day = F.date_add(a, (F.floor(k / per) * 7 + F.element_at(offset, (k % per + 1).cast("int"))).cast("int"))
    return Value(F.date_format(day, "yyyy-MM-dd"), STRING)


@function("date.weekday", "weekday")
def _weekday(values, scope):
    return _weekdays(values, scope, [1, 2, 3, 4, 5])


@function("date.weekend", "weekend")
def _weekend(values, scope):
    return _weekdays(values, scope, [0, 6])


@special("date.dayOfWeek", "dayOfWeek")
def _day_of_week(args, scope):
    from .compiler import compiled

    return _weekdays([compiled(a, scope) for a in args[1:]], scope, [int(constant(args, 0, 1)) % 7])


# -- distributions


def _normal(scope) -> Column:
    u, v = F.greatest(scope.uniform("normal"), F.lit(1e-12)), scope.uniform("normal")
    return F.sqrt(-2 * F.log(u)) * F.cos(v * 6.283185307179586)


def _clamped(x: Column, low: Value, high: Value) -> Value:
    x = F.greatest(x, V.number(low)) if low.kind == "number" else x
    return Value(F.least(x, V.number(high)) if high.kind == "number" else x, DOUBLE)


@function("gaussian", "normal")
def _gaussian(values, scope):
    mean, deviation = V.strict_number(arg(values, 0), 0), V.strict_number(arg(values, 1), 1)
    return _clamped(mean + deviation * _normal(scope), arg(values, 2), arg(values, 3))


@function("lognormal")
def _lognormal(values, scope):
    mu, sigma = V.strict_number(arg(values, 0), 0), V.strict_number(arg(values, 1), 1)
    return _clamped(F.exp(mu + sigma * _normal(scope)), arg(values, 2), arg(values, 3))


@function("exponential")
def _exponential(values, scope):
    low = V.strict_number(arg(values, 1), 0)
    u = F.greatest(1 - scope.uniform("exponential"), F.lit(1e-12))
    return _clamped(low - F.log(u) / V.strict_number(arg(values, 0), 1), V.literal(None), arg(values, 2))


@special("poisson")
def _poisson(args, scope):
    """By the inverse of the distribution function below 30, where its table is short; by a rounded normal above."""
    import math

    lam = float(constant(args, 0, 1))
    if lam >= 30:
        return Value(F.greatest(F.lit(0.0), F.floor(lam + math.sqrt(lam) * _normal(scope) + 0.5)).cast("long"), LONG)
    u, chance, total, table, k = scope.uniform("poisson"), math.exp(-lam), 0.0, [], 0
    while total < 1 - 1e-12 and k < 200:
        total += chance
        table.append(total)
        k += 1
        chance *= lam / k
    steps = F.array(*[F.lit(x) for x in table])
    return Value(F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + (u >= x).cast("long")), LONG)


@function("uniform")
def _uniform(values, scope):
    a, b = V.strict_number(arg(values, 0), 0), V.strict_number(arg(values, 1), 1)
    return Value(a + scope.uniform("uniform") * (b - a), DOUBLE)


@special("beta")
def _beta(args, scope):
    """By the inverse of the distribution function, tabulated at 512 even steps when the plan is made."""
    import numpy as np

    a, b = float(constant(args, 0, 1)), float(constant(args, 1, 1))
    x = (np.arange(200_000) + 0.5) / 200_000
    w = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
    c = np.cumsum(w) / w.sum()
    table = np.interp(np.arange(513) / 512, c, x)
    steps = F.array(*[F.lit(float(round(v, 9))) for v in table])
    at = scope.uniform("beta") * 512
    k = F.floor(at).cast("int")
    low, high = F.element_at(steps, k + 1), F.element_at(steps, F.least(k + 2, F.lit(513)))
    return Value(low + (high - low) * (at - k), DOUBLE)


# -- regular expressions on data


def _flagged(pattern: str, flags: str) -> str:
    known = "".join(f for f in flags if f in "ims")
    return f"(?{known}){pattern}" if known else pattern


def _pattern(name: str, *names: str):
    def put(build):
        @special(name, *names)
        def call(args, scope):
            from .compiler import compiled

            v = compiled(args[1], scope)
            rest = [a.value for a in args[2:] if isinstance(a, S.Literal)]
            out = build(_flagged(str(constant(args, 0, "")), rest[-1] if rest and name == "regex.test" else ""), V.text(v), rest)
            out.error = v.error
            return out

        return call

    return put


@_pattern("regex.test", "matches")
def _test(p, s, rest):
    return Value(F.regexp_like(s, F.lit(p)), BOOLEAN)


@_pattern("regex.find")
def _find(p, s, rest):
    return Value(F.when(F.regexp_like(s, F.lit(p)), F.regexp_extract(s, p, 0)), STRING)


@_pattern("regex.matchAll")
def _match_all(p, s, rest):
    return Value(F.regexp_extract_all(s, F.lit(p), F.lit(0)), T.ArrayType(STRING))


@_pattern("regex.capture")
def _capture(p, s, rest):
    import re

    groups = re.compile(p).groups
    return Value(F.when(F.regexp_like(s, F.lit(p)), F.array(*[F.regexp_extract(s, p, i) for i in range(1, groups + 1)])), T.ArrayType(STRING))


@_pattern("regex.replace")
def _regex_replace(p, s, rest):
    by = str(rest[0]) if rest else ""
    if len(rest) > 1 and "g" not in str(rest[1]):
        # only the first: what stands before it is kept by a lazy group
        return Value(F.regexp_replace(s, f"(?s)^(.*?)(?:{p})", "$1" + by), STRING)
    return Value(F.regexp_replace(s, p, by), STRING)


@_pattern("regex.split")
def _split(p, s, rest):
    return Value(F.split(s, p, -1), T.ArrayType(STRING))


# Words for plain strings.
WORDS = "amber basin cedar delta ember field grove haven inlet jetty knoll ledge marsh north ocean prairie quarry ridge stone trail upland valley willow yonder zephyr".split()


def word(u: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(WORDS)), " "), (F.floor(u * len(WORDS)) + 1).cast("int"))
