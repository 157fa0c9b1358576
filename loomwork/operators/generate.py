"""Generating the tables that a description states.

Every draw is a hash of the seed, the place in the description, the row's number and the attempt, so a row is a pure
function of its number: the same seed gives the same tables however they are partitioned, and a lost task redoes its rows
alone. Fields are computed in levels, each a projection that uses the one before; a nested collection is an array of
structs built the same way; a reference is an ordinal that an equi-join looks up.

Rejection: a row that must satisfy rules is tried FIRST times at once, and up to ATTEMPTS times if none of those
holds; this is one expression, without loops on the driver and without a shuffle. Where the rules read referenced rows,
references are drawn anew for each attempt: rows are multiplied by their attempts, look up what each refers to, and only
the number of the first attempt that holds is kept; the row itself is then made once, from that number.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from math import ceil, floor, gcd
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import values as V
from ..functions.builtins import REGISTRY, constant
from ..functions.compiler import CompileError, Scope, compiled, row_scope
from ..functions.domains import PATTERNS, slots
from ..functions.values import Value
from ..plans import syntax as S
from ..workspace import folder
from . import running
from .check import dataset_rules, holds

LOG = logging.getLogger("loomwork.generate")
FIRST, ATTEMPTS, DATASET_ATTEMPTS = 8, 100, 20
#: A field with ``?`` on a range, reference or collection is left out with this chance.
OPTIONAL = 0.3
ROW, NUMBER, TRY, UNMET = "_row", "__i", "__try", "__unmet"
#: Rows that an ordinal group aims at.
GROUP_ROWS = 50_000
#: Rows that change one target and are gathered at once.
FOLDED = 20_000


# Words in a plain string field's name (or in its schema's) and the generator that they stand for.
COMPANIES, PEOPLE, THINGS = ("company", "business", "organization"), ("person", "customer", "contact"), ("product", "item", "description")


def named_string(field_: str, schema: str) -> str | None:
    """The generator that suits a plain string by its name: a company's name, a person's, a product's."""
    low = field_.lower()
    told = lambda words, text: any(w in text for w in words)
    if told(COMPANIES, low) or low == "name" and told(COMPANIES, schema.lower()):
        return "companyName"
    if low == "name" or told(PEOPLE, low):
        return "fullName"
    return "faker.commerce.productName" if told(THINGS, low) else None


# The kinds of warnings.
UNIQUE, RETRIES, TARGET, UNKNOWN = "UniqueValueExhaustion", "ConstraintRetryLimit", "MutationTargetNotFound", "UnknownFieldInImportedSchema"
EVALUATION = "ConstraintEvaluationError"


class Warned(str):
    """A warning's text, with its ``kind``."""

    kind: str


class ConstraintError(RuntimeError):
    """In strict mode: rows that no attempt could satisfy."""


@dataclass
class Options:
    seed: int = 0
    strict: bool = False
    optional: float = OPTIONAL
    #: Warns of the rows that break their rules after all attempts. They are counted while a collection's rows are written
    #: or read to their end; ``Generator.warnings`` counts by a job of its own only where none has been.
    report: bool = True
    #: Attempts of a row and of a dataset.
    attempts: int = ATTEMPTS
    dataset_attempts: int = DATASET_ATTEMPTS
    imports: dict[str, dict[str, list[S.Field]]] = field(default_factory=dict)
    functions: dict = field(default_factory=dict)
    #: Tables at hand, by the name under which datasets may refer to them, change them or make rows for each of theirs. Rows
    #: are numbered by ``_row`` from 0 (``running.numbered``); tables without it are numbered in an order of their own.
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Made:
    """A generated collection: rows with ``_row``, hidden columns and, for references, ``__fk_<field>``."""

    name: str
    schema: S.Schema
    frame: DataFrame
    count: int
    references: dict[str, str] = field(default_factory=dict)
    private: set[str] = field(default_factory=set)
    #: What to say of so many rows that satisfy no attempt, while that isn't known yet.
    unmet: Callable[[int], str] | None = None
    #: The rows that satisfy no attempt.
    attempted: DataFrame | None = None

    def shown(self) -> DataFrame:
        hidden = [c for c in self.frame.columns if c == ROW or c.startswith("__") or c in self.private]
        return self.frame.drop(*hidden)


def uniform(seed: int, label: str, *keys: Column) -> Column:
    """A number in [0, 1) that the keys decide."""
    h = F.xxhash64(F.lit(seed).cast("long"), F.lit(label), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") * (2.0**-53)


def permutation(row: Column, size: int, seed: int, label: str, rounds: int = 12) -> Column:
    """The place of ``row`` in a permutation of 0 to ``size`` - 1 that seed and label decide: a swap-or-not shuffle (after
    Hoang, Morris and Rogaway, 2012). In each round a place may change with the one that mirrors it at a key, as a hash of
    the pair tells, so each round is a permutation, whatever the size."""
    import random

    r = random.Random(f"{seed}:{label}:{size}")
    keys = F.array(*[F.struct(F.lit(r.randrange(size)).cast("long").alias("key"), F.lit(r.getrandbits(60)).alias("salt")) for _ in range(rounds)])

    def swap(x: Column, k: Column) -> Column:
        other = F.pmod(k["key"] - x, F.lit(size).cast("long"))
        return F.when(F.xxhash64(F.greatest(x, other), k["salt"]).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(keys, F.pmod(row.cast("long"), F.lit(size).cast("long")), swap)


def _days(ends: list) -> tuple[str, int] | None:
    """First day and number of days between two years or ISO days, both included; an open end is today."""
    days = []
    for value, last in zip(ends, (False, True), strict=True):
        if value is None and not last:
            return None
        if value is None:
            days.append(date.today())
        elif isinstance(value, int | float):
            days.append(date(int(value), 12, 31) if last else date(int(value), 1, 1))
        else:
            try:
                days.append(date.fromisoformat(str(value)))
            except ValueError:
                return None
    return days[0].isoformat(), (days[1] - days[0]).days + 1


def names_in(node: S.Node | None) -> set[str]:
    return {n.parts[0] for n in S.walk(node) if isinstance(n, S.Path)} if node is not None else set()


def levels(fields: list[S.Field], schemas: dict[str, S.Schema] | None = None) -> list[list[S.Field]]:
    """Fields by the level at which all that they name is known; a circle is an error."""
    by_name = {f.name: f for f in fields}
    level: dict[str, int] = {}

    def of(name: str, above: tuple[str, ...]) -> int:
        if name in above:
            raise CompileError(f"Circular dependency detected: {' -> '.join([*above, name])}")
        if name not in level:
            f = by_name[name]
            needs = (names_in(f.type) | names_in(f.when)) & set(by_name) - {name}
            needs |= _parents(f.type, schemas or {}) & set(by_name) - {name}
            level[name] = 1 + max((of(n, (*above, name)) for n in needs), default=-1)
        return level[name]

    for f in fields:
        of(f.name, ())
    out: list[list[S.Field]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for f in fields:
        out[level[f.name]].append(f)
    return out


def _parents(node: S.Node, schemas: dict[str, S.Schema]) -> set[str]:
    """What the rows of a nested schema read of the row around them."""
    inner = node.element if isinstance(node, S.Many) else node
    schema = schemas.get(inner.parts[0]) if isinstance(inner, S.Path) else None
    if schema is None:
        return {n.parts[0] for n in S.walk(node) if isinstance(n, S.Parent)}
    nodes = [x for f in schema.fields for x in (f.type, f.when) if x is not None] + [x for a in schema.assumes for x in (*a.rules, a.condition) if x is not None]
    return {n.parts[0] for x in nodes for n in S.walk(x) if isinstance(n, S.Parent)}


class Generator:
    """Generates the datasets of a description: ``Generator(spark, text).run()`` gives DataFrames by collection."""

    def __init__(self, spark: SparkSession, source: str | S.Program, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.program = S.parse(source) if isinstance(source, str) else source
        self.schemas, self.datasets = self.program.all(S.Schema), self.program.all(S.Dataset)
        self.lets = {n: x.value for n, x in self.program.all(S.Let).items()}
        self.distributions = self.program.all(S.Distribution)
        self.made: dict[str, Made] = {}
        self.sequences: dict[tuple, int] = {}
        self._warnings: list[Warned] = []
        self.pending: list[tuple[Observation | None, DataFrame, Made]] = []  # collections whose unmet rows aren't counted yet
        self.salt, self.labels = 0, 0
        self.before = None  # what ``previous`` means while rows are made in turn
        self.column = F.col  # where columns of the row being made are found
        # references inside nested collections, by place: being gathered, and gathered (collection, column)
        self.inside: dict[str, tuple[str, str]] | None = None
        self.drawn_inside: dict[str, tuple[str, str]] = {}
        # sequences inside nested collections, by place: being gathered (mark), and counted (column of the row's first
        # number, column of the row's elements, and how many there are in all rows)
        self.counting: dict[str, str] | None = None
        self.counted: dict[str, tuple[str, str, T.DataType, int]] = {}
        self.picks: dict[tuple, tuple[DataFrame, int]] = {}

    # -- whole programs

    def run(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for d in self.datasets.values():
            most = self.options.dataset_attempts
            for attempt in range(most + 1):
                self.salt, self.labels, self.sequences = attempt, 0, {}
                known = len(self.pending)
                frames = self.dataset(d)
                if not d.rules or attempt == most:
                    break
                inner = {n: m.frame for n, m in self.made.items()}
                outcomes = dataset_rules(list(d.rules), inner, self.lets).collect()
                for r in outcomes:
                    if r["failed"]:
                        self.warn(EVALUATION, f"dataset {d.name}: {r['rule']} can't be evaluated")
                if all(r["ok"] for r in outcomes) != d.violating:
                    break
                del self.pending[known:]  # of rows that are thrown away
            if d.rules and attempt == most:
                self.warn(RETRIES, f"dataset {d.name}: its rules don't hold after {most} attempts")
            out |= frames
        return out

    @property
    def warnings(self) -> list[Warned]:
        """All warnings so far. Unmet rows are known from the run that wrote or read a collection to its end; where there
        was none, or it saw only a part of the rows, they are counted now."""
        waiting, self.pending = self.pending, []
        for seen, counted, made in waiting:
            found = seen.get if seen is not None and seen._jo.future().isCompleted() else {}
            bad = found["unmet"] if found.get("rows") == made.count else counted.count()
            if bad:
                self.warn(RETRIES, made.unmet(bad))
        return self._warnings

    def warn(self, kind: str, text: str) -> None:
        if text not in self._warnings:
            said = Warned(text)
            said.kind = kind
            self._warnings.append(said)
            LOG.warning("%s: %s", kind, text)

    def at_hand(self) -> dict[str, Made]:
        """The given tables as collections."""
        out = {}
        for name, df in self.options.tables.items():
            df = df if ROW in df.columns else running.numbered(df)
            out[name] = Made(name, self.schemas.get(name, S.Schema(name, ())), df, df.count())
        return out

    def dataset(self, d: S.Dataset) -> dict[str, DataFrame]:
        self.made, self.picks = self.at_hand(), {}
        for c in d.collections:
            if c.schema not in self.schemas:
                raise CompileError(f"collection {c.name!r} names no schema {c.schema!r}")
            made = self.collection(c, d.violating)
            self.made[c.name] = made
            if made.schema.mutations:
                self.mutate(made)
        own = {c.name for c in d.collections}
        return {n: self.watched(self.embedded(m)).shown() for n, m in self.made.items() if n in own or getattr(m, "changed", False)}

    def watched(self, made: Made) -> Made:
        """A collection that counts its unmet rows as it is run through."""
        if made.unmet is None:
            return made
        if UNMET not in made.frame.columns:
            self.pending.append((None, made.attempted, made))
            return made
        seen = Observation()
        self.pending.append((seen, made.attempted, made))
        return replace(made, frame=made.frame.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(UNMET).alias("unmet")))

    def fields(self, schema: S.Schema, overrides: tuple[S.Field, ...] = ()) -> list[S.Field]:
        """A schema's fields over those of its base, under a collection's overrides."""
        out: dict[str, S.Field] = {}
        if schema.base:
            base = self.options.imports.get(schema.base[0], {}).get(schema.base[-1])
            if base is None and schema.base[-1] in self.schemas:
                base = self.fields(self.schemas[schema.base[-1]])
            if base is None:
                raise CompileError(f"nothing is known of {'.'.join(schema.base)}")
            known = {f.name for f in base}
            for f in schema.fields:
                if f.name not in known and len(schema.base) > 1:
                    self.warn(UNKNOWN, f"{schema.name}.{f.name} isn't a field of {'.'.join(schema.base)}")
            out |= {f.name: f for f in base}
        out |= {f.name: f for f in schema.fields}
        out |= {f.name: f for f in overrides}
        return list(out.values())

    def count(self, node: S.Node, label: str) -> int:
        """A collection's size, decided by the seed on the driver."""
        import random

        r = random.Random(f"{self.options.seed}:{self.salt}:{label}")
        if isinstance(node, S.Literal):
            n = int(node.value)
        elif isinstance(node, S.Range) and isinstance(node.low, S.Literal) and isinstance(node.high, S.Literal):
            n = r.randint(int(node.low.value), int(node.high.value))
        else:
            v = compiled(node, Scope(lets=self.lets, functions=REGISTRY | self.options.functions, draw=lambda _: F.lit(r.random())))
            n = int(self.spark.range(1).select(v.column).first()[0])
        if n < 0:
            raise CompileError(f"{label}: a collection can't have {n} rows")
        return n

    # -- collections

    def collection(self, c: S.Collection, violating: bool) -> Made:
        schema = self.schemas[c.schema]
        fields = self.fields(schema, c.overrides)
        made = Made(c.name, schema, None, 0, private={f.name for f in fields if f.private})
        if c.per:
            parent = self.made[c.per]
            each = self.count(c.count, c.name)
            df = parent.frame.select(F.col(ROW).alias("__fk_parent")).select(F.explode(F.slice(F.sequence(F.lit(0), F.lit(each)), 1, each)).alias("__n"), "__fk_parent")
            df = df.select((F.col("__fk_parent") * each + F.col("__n")).alias(ROW), "__fk_parent")
            made.count, made.references = parent.count * each, {"parent": c.per}
        else:
            made.count = self.count(c.count, c.name)
            df = self.spark.range(made.count).withColumnRenamed("id", ROW)
        label = f"{c.name}.{schema.name}"
        rules = bool(schema.assumes)
        later, in_turn = self._later(fields, schema)
        inside = self._nested(fields, lambda f: isinstance(f.type, S.AnyOf) and f.type.collection.parts[0] in self.made)
        numbering = not in_turn and self._nested(fields, lambda f: any(isinstance(n, S.Call) and n.name in ("sequence", "sequenceInt") for n in S.walk(f.type)))
        redrawn = rules and not in_turn and (inside or numbering or self._read_by_rules(schema, fields))
        start = self.labels

        def look_up(df: DataFrame, last: bool = True) -> tuple[DataFrame, dict[str, Value]]:
            df, given = self.referenced(df, fields, made, schema.name, TRY if redrawn else None)
            if c.per:
                given["parent"] = row_scope(df.schema, self.lets, self.options.functions).fields["parent"]
            self.counted = {}
            if inside or numbering and last:
                self.inside, self.counting, begin = {}, {}, self.labels
                self.before = (lambda args, s: V.literal(None)) if in_turn else None
                try:
                    _, arr, kind = attempts(F.array(TRY) if redrawn else F.sequence(F.lit(0), F.lit(0)), given)
                finally:
                    self.drawn_inside, self.inside, self.before = self.inside, None, None
                    marks, self.counting = self.counting, None
                    self.labels = begin  # the rows themselves draw the same
                df = self.looked_up_inside(df, arr, kind, [ROW, TRY] if redrawn else [ROW])
                if numbering and last:
                    df = self.numbered_inside(df, arr, kind, marks, made.count)
            return df, given

        def attempts(numbers: Column, given: dict[str, Value], row: Column = F.col(ROW)) -> tuple[Column, Column, T.StructType]:
            """The attempts that satisfy the rules, all of them, and their type."""
            now = [f for f in fields if f not in later and f.name not in given]
            numbers = F.transform(numbers, lambda i: F.struct(i.alias(NUMBER)))
            arr, kind = self.elements(numbers, T.StructType([T.StructField(NUMBER, T.IntegerType())]), now, schema, label, [row], Scope(lets=self.lets), made.count, given)
            if not rules:
                return arr, arr, kind

            def fits(x: Column) -> Column:
                scope = self.scope(x, kind, [row, x[NUMBER]], label, None, given)
                ok = holds(schema, scope)
                return ~ok if violating else ok

            return F.filter(arr, fits), arr, kind

        if in_turn:
            df, given = look_up(df)
            df, kind = self.in_turn(df, given, attempts, rules, made.count)
        elif redrawn:

            def first_fit(rows: DataFrame, first: int, count: int) -> DataFrame:
                """The first of some attempts that satisfies the rules, of each row that has one."""
                self.labels = start
                rows, given = look_up(rows.withColumn(TRY, F.explode(F.sequence(F.lit(first), F.lit(first + count - 1)))), False)
                fitting = rows.where(F.size(attempts(F.array(TRY), given)[0]) > 0)
                return fitting.groupBy(ROW).agg(F.min(TRY).alias(TRY))

            few = first_fit(df, 0, min(FIRST, self.options.attempts))
            if self.options.attempts > FIRST:
                few = few.unionByName(first_fit(df.join(few, ROW, "left_anti"), FIRST, self.options.attempts - FIRST))
            df = df.join(few, ROW, "left").withColumn(UNMET, F.col(TRY).isNull())
            df = df.withColumn(TRY, F.coalesce(TRY, F.lit(0)))
            self.labels = start
            df, given = look_up(df)
            _, arr, kind = attempts(F.array(TRY), given)
            df = df.withColumn("__one", F.try_element_at(arr, F.lit(1))).drop(TRY)
        elif rules:
            df, given = look_up(df)
            first = min(FIRST, self.options.attempts)
            few, tried, kind = attempts(F.sequence(F.lit(0), F.lit(first - 1)), given)
            one = F.try_element_at(few, F.lit(1))
            if self.options.attempts > first:
                one = F.coalesce(one, F.try_element_at(attempts(F.sequence(F.lit(first), F.lit(self.options.attempts - 1)), given)[0], F.lit(1)))
            df = df.withColumn("__one", one)
            df = df.withColumn(UNMET, F.col("__one").isNull()).withColumn("__one", F.coalesce("__one", F.try_element_at(tried, F.lit(1))))
        else:
            df, given = look_up(df)
            arr, _, kind = attempts(F.sequence(F.lit(0), F.lit(0)), given)
            df = df.withColumn("__one", F.try_element_at(arr, F.lit(1)))
        names = [f.name for f in kind.fields if f.name != NUMBER]
        if not in_turn:
            df = df.select(*[x for x in df.columns if x != "__one"], *[F.col("__one").getField(n).alias(n) for n in names])
        if rules and (self.options.strict or self.options.report):
            most = self.options.attempts
            made.unmet = lambda bad: f"{schema.name}: {bad} of {made.count} rows satisfy no attempt of {most} ({'violating' if violating else 'satisfying'})"
            made.attempted = df.where(UNMET)
            if self.options.strict:  # nothing may come out before all rows are known to satisfy
                if bad := made.attempted.count():
                    raise ConstraintError(made.unmet(bad))
                made.unmet = None
        for f in later:
            df = self.lagged(df, f, made.count) if self._wanted(f) else self.derived(df, f, schema, label, made.count)
        order = [f.name for f in fields if f.name in df.columns]
        hidden = [x for x in df.columns if x not in order]
        made.frame = df.select(*hidden, *order)
        return made

    def _read_by_rules(self, schema: S.Schema, fields: list[S.Field]) -> bool:
        """Whether the rules read drawn references, themselves or through other fields."""
        reading = {f.name for f in fields if isinstance(f.type, S.AnyOf) and f.type.collection.parts[0] in self.made}
        more = True
        while more:
            more = {f.name for f in fields if (names_in(f.type) | names_in(f.when)) & reading} - reading
            reading |= more
        named = {n for a in schema.assumes for x in (*a.rules, a.condition) for n in names_in(x)}
        return bool(named & reading)

    @staticmethod
    def _wanted(f: S.Field) -> list[str]:
        """What a field reads of the row before."""
        return sorted({constant(n.args, 0) for x in (f.type, f.when) if x is not None for n in S.walk(x) if isinstance(n, S.Call) and n.name == "previous"})

    def _later(self, fields: list[S.Field], schema: S.Schema) -> tuple[list[S.Field], bool]:
        """The fields that read the row before, or fields that do, in the order in which whole columns of them can be made;
        and whether they can't be, so that rows have to be made in turn: fields in a circle through the row before that no
        running sum of chunks gives, or rules that read such fields."""
        by_name = {f.name: f for f in fields}
        late = {f.name for f in fields if self._wanted(f)}
        if not late:
            return [], False
        more = True
        while more:
            more = {f.name for f in fields if f.name not in late and (names_in(f.type) | names_in(f.when) | _parents(f.type, self.schemas)) & late}
            late |= more
        named = {n for a in schema.assumes for x in (*a.rules, a.condition) for n in names_in(x)}
        refined = {f.name for r in schema.refinements for f in r.fields} | {n for r in schema.refinements for n in names_in(r.condition)}
        if (named | refined) & late:
            return [], True
        out: list[S.Field] = []
        while len(out) < len(late):
            done = {f.name for f in out}
            ready = [by_name[n] for n in sorted(late - done) if (names_in(by_name[n].type) | names_in(by_name[n].when) | set(self._wanted(by_name[n]))) & (late - done) <= {n}]
            if not ready:
                return [], True
            out += ready
        own = [f for f in out if f.name in self._wanted(f)]
        short = lambda f: any(law(f.type, running.previous_of(f.name)) is not None for law in (running.linear, running.clamp))
        if any(self._wanted(f) != [f.name] or f.when is not None or f.optional or not short(f) for f in own):
            return [], True
        return out, False

    def lagged(self, df: DataFrame, f: S.Field, rows: int | None = None) -> DataFrame:
        """A field that reads the row before: rows are joined with the next by number, so no order of the whole table is
        needed. One that multiplies its own previous value and adds to it runs on through chunks of rows."""
        wanted = self._wanted(f)
        if f.name in wanted:
            return self.run_on(df, f, df.count() if rows is None else rows)
        before = df.select((F.col(ROW) + 1).alias("__prev"), *[F.col(w).alias(f"__prev_{w}") for w in wanted])
        df = df.join(before, F.col(ROW) == F.col("__prev"), "left").drop("__prev")
        scope = row_scope(df.schema, self.lets, self.options.functions)
        scope.draw = self.drawer([F.col(ROW)], f.name)
        scope.functions["previous"] = lambda args, s: scope.fields[f"__prev_{constant(args, 0)}"]
        v = compiled(f.type, scope)
        if f.when is not None:
            v = _either(V.truth(compiled(f.when, scope)), v, None)
        df = df.withColumn(f.name, v.column)
        return df.drop(*[f"__prev_{w}" for w in wanted])

    def run_on(self, df: DataFrame, f: S.Field, rows: int) -> DataFrame:
        """A field made of its own previous value by a rate and an addition, or by an addition up to a bound."""
        if (stop := running.clamp(f.type, running.previous_of(f.name))) is not None:
            scope = row_scope(df.schema, self.lets, self.options.functions)
            scope.draw = self.drawer([F.col(ROW)], f.name)
            add = compiled(stop[0], scope)
            df = df.withColumn("__add", V.number(add).cast(T.LongType() if add.whole else T.DoubleType())).withColumn("__bound", F.lit(stop[1]))
            return running.mapped(df, ROW, running.bounded(stop[2]), {"add": F.col("__add"), "bound": F.col("__bound")}, rows, f.name).drop("__add", "__bound")
        parts = running.linear(f.type, running.previous_of(f.name))
        if parts is None:
            raise CompileError(f"{f.name} isn't made of its own previous value by a rate and an addition")
        scope = row_scope(df.schema, self.lets, self.options.functions)
        scope.draw = self.drawer([F.col(ROW)], f.name)
        scope.functions["previous"] = lambda args, s: V.literal(None)
        first, rate, add = (compiled(x, scope) for x in (f.type, *parts))
        kind = T.LongType() if rate.whole and add.whole else T.DoubleType()
        begins = F.col(ROW) == 0
        df = df.withColumn("__add", F.when(begins, V.number(first)).otherwise(V.number(add)).cast(kind))
        if parts[0] == S.Literal(1):
            return running.before_each(df, ROW, F.col("__add"), rows, "__sum").withColumn(f.name, F.col("__sum") + F.col("__add")).drop("__sum", "__add")
        df = df.withColumn("__rate", F.when(begins, 0).otherwise(V.number(rate)).cast(kind))
        return running.affine(df, ROW, F.col("__rate"), F.col("__add"), rows, f.name).drop("__rate", "__add")

    def derived(self, df: DataFrame, f: S.Field, schema: S.Schema, label: str, rows: int) -> DataFrame:
        """A field made of such fields."""
        scope = row_scope(df.schema, self.lets, self.options.functions)
        scope.draw = self.drawer([F.col(ROW)], f.name)
        v = self.value(f, scope, schema, label, [F.col(ROW)], F.col(ROW), rows)
        if f.when is not None:
            v = _either(V.truth(compiled(f.when, scope)), v, None)
        return df.withColumn(f.name, v.column)

    def in_turn(self, df: DataFrame, given: dict[str, Value], attempts, rules: bool, rows: int) -> tuple[DataFrame, T.StructType]:
        """Rows made one after another, each from the row before: the first attempt that satisfies the rules counts."""
        start, kind = self.labels, T.StructType([])
        few = min(FIRST, self.options.attempts)

        def row(state: Column, r: Column, kind: T.StructType) -> tuple[Column, T.StructType]:
            known = {f.name: f.dataType for f in kind.fields}
            self.labels = start
            # until a field's type is known it is taken for a number
            self.before = lambda args, s: Value(state.getField(n), known[n]) if (n := constant(args, 0)) in known else Value(F.lit(None).cast("long"), T.LongType())
            own = {n: Value(r.getField(n), v.type) for n, v in given.items()}
            self.column = r.getField
            try:
                fitting, tried, made = attempts(F.sequence(F.lit(0), F.lit(few - 1 if rules else 0)), own, r[ROW])
                one = F.try_element_at(fitting, F.lit(1))
                if rules and self.options.attempts > few:
                    self.labels = start
                    one = F.coalesce(one, F.try_element_at(attempts(F.sequence(F.lit(few), F.lit(self.options.attempts - 1)), own, r[ROW])[0], F.lit(1)))
            finally:
                self.before, self.column = None, F.col
            names = [f.name for f in made.fields if f.name != NUMBER]
            pick = F.array(F.struct(one.isNull().alias("unmet"), F.coalesce(one, F.try_element_at(tried, F.lit(1))).alias("one")))
            whole = F.transform(pick, lambda p: F.struct(*[p["one"].getField(n).alias(n) for n in names], p["unmet"].alias(UNMET)))
            return F.element_at(whole, 1), T.StructType([*[f for f in made.fields if f.name != NUMBER], T.StructField(UNMET, T.BooleanType())])

        for _ in range(8):
            before, kind = kind, row(F.lit(None).cast(kind), F.struct(*[F.col(f"`{c}`") for c in df.columns]), kind)[1]
            if before == kind:
                break
        df = running.in_turn(df, ROW, rows, kind, lambda state, r: row(state, r, kind)[0])
        if not rules:
            df = df.drop(UNMET)
        return df, T.StructType([f for f in kind.fields if f.name != UNMET])

    # -- references

    def referenced(self, df: DataFrame, fields: list[S.Field], made: Made, label: str, attempt: str | None = None) -> tuple[DataFrame, dict[str, Value]]:
        """``df`` with the row that each ``any of`` field draws, embedded as a struct, and its number. A column ``attempt``
        makes the draws differ from attempt to attempt."""
        keys = [F.col(ROW)] if attempt is None else [F.col(ROW), F.col(attempt)]
        given: dict[str, Value] = {}
        if "__fk_parent" in df.columns:
            df = self.joined(df, "parent", made.references["parent"])
        for f in fields:
            if not isinstance(f.type, S.AnyOf):
                continue
            name = f.type.collection.parts[0]
            if name not in self.made:
                df = df.withColumn(f.name, F.lit(None).cast("string"))
                given[f.name] = Value(F.col(f.name), T.NullType())
                continue
            source = self.made[name]
            u = uniform(self.options.seed + self.salt * 1_000_003, f"{label}.{f.name}", *keys)
            if f.optional:
                u = F.when(uniform(self.options.seed, f"{label}.{f.name}?", *keys) >= self.options.optional, u)
            if f.type.condition is None:
                df = df.withColumn(f"__fk_{f.name}", F.floor(u * source.count).cast("long") if source.count else F.lit(None).cast("long"))
            else:
                known = (made.name, f.name)
                if known not in self.picks:
                    self.picks[known] = self.ordinals(source, f.type.condition)
                ordinals, n = self.picks[known]
                pick = F.floor(u * n).cast("long") if n else F.lit(None).cast("long")
                df = df.withColumn("__pick", pick).join(ordinals, F.col("__pick") == F.col("__ord"), "left").withColumnRenamed("__to", f"__fk_{f.name}").drop("__pick", "__ord")
            df = self.joined(df, f.name, name)
            made.references[f.name] = name
            given[f.name] = Value(F.col(f.name), df.schema[f.name].dataType)
        return df, given

    def joined(self, df: DataFrame, field_: str, name: str) -> DataFrame:
        """Looks up the rows of a collection by number. The planner sends the looked-up side along when it is small."""
        shown = self.made[name].shown().columns
        side = self.made[name].frame.select(F.col(ROW).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in shown]).alias(field_))
        return df.join(side, F.col(f"__fk_{field_}") == F.col("__at"), "left").drop("__at")

    def ordinals(self, source: Made, condition: S.Node) -> tuple[DataFrame, int]:
        """The numbers of the rows that satisfy a condition, densely numbered themselves: counts by group of numbers first,
        then within each group, so no task orders them all."""
        scope = row_scope(source.frame.schema, self.lets, self.options.functions)
        kept = source.frame.where(V.truth(compiled(condition, scope))).select(F.col(ROW).alias("__to"), F.floor(F.col(ROW) / GROUP_ROWS).alias("__g"))
        sums = kept.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
        n = sums.agg(F.sum("__n")).first()[0] or 0
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select(F.col("__g").alias("__h"), before.alias("__before"))
        rank = F.row_number().over(Window.partitionBy("__g").orderBy("__to")) - 1
        out = kept.join(sums, F.col("__g") == F.col("__h")).select("__to", (rank + F.col("__before")).cast("long").alias("__ord"))
        return out, n

    def embedded(self, made: Made) -> Made:
        """References looked up again where their collection has been changed since."""
        df = made.frame
        for f, name in made.references.items():
            if getattr(self.made[name], "changed", False) and f in df.columns:
                order = df.columns
                df = self.joined(df.drop(f), f, name).select(*order)
        return replace(made, frame=df)

    # -- rows as elements of arrays

    def drawer(self, keys: list[Column], label: str):
        seed = self.options.seed + self.salt * 1_000_003

        def draw(what: str) -> Column:
            self.labels += 1
            return uniform(seed, f"{label}.{what}.{self.labels}", *keys)

        return draw

    def scope(self, x: Column, kind: T.StructType, keys: list[Column], label: str, parent: Scope | None, given: dict[str, Value] | None = None) -> Scope:
        fields = {f.name: Value(x[f.name], f.dataType) for f in kind.fields}
        own = {"previous": self.before} if self.before else {}
        return Scope({**(given or {}), **fields}, parent, self.lets, self.drawer(keys, label), REGISTRY | self.options.functions | own)

    def elements(self, numbers: Column, kind: T.StructType, fields: list[S.Field], schema: S.Schema, label: str, keys: list[Column], parent: Scope | None, rows: int, given: dict[str, Value] | None = None) -> tuple[Column, T.StructType]:
        """``numbers`` (an array of structs with NUMBER) with all ``fields``, level by level."""
        arr = numbers
        steps: list[list[S.Field]] = levels(fields, self.schemas)
        for r in schema.refinements:
            steps.append([replace(f, when=S.Logical("and", r.condition, f.when) if f.when else r.condition, where=S.Literal("refine")) for f in r.fields])
        for step in steps:
            # types first, from expressions over a stand-in, then the projection itself with the same draws
            start, out = self.labels, []
            stand_in = F.lit(None).cast(kind)

            def value(f: S.Field, x: Column, kind=kind) -> Value:
                scope = self.scope(x, kind, [*keys, x[NUMBER]], f"{label}.{f.name}", parent, given)
                v = self.value(f, scope, schema, label, [*keys, x[NUMBER]], keys[0] if len(keys) == 1 else x[NUMBER].cast("long"), rows)
                if f.when is not None:
                    c = V.truth(compiled(f.when, scope))
                    old = scope.fields.get(f.name) if f.where == S.Literal("refine") else None
                    v = _either(c, v, old)
                if f.optional and not isinstance(f.type, (S.Choice,)):
                    u = scope.uniform("optional")
                    v = Value(F.when(u >= self.options.optional, v.column), v.type)
                return v

            for f in step:
                out.append((f.name, value(f, stand_in).type))
            made = [T.StructField(n, t if not isinstance(t, T.NullType) else T.StringType()) for n, t in out]
            kept = [f for f in kind.fields if f.name not in {n for n, _ in out}]

            def project(x: Column, step=step, kept=kept, made=made, start=start) -> Column:
                self.labels = start
                new = [value(f, x).column.cast(m.dataType).alias(f.name) for f, m in zip(step, made, strict=True)]
                return F.struct(*[x[f.name].alias(f.name) for f in kept], *new)

            arr = _mapped(arr, project)
            kind = T.StructType([*kept, *made])
        return arr, kind

    def value(self, f: S.Field, scope: Scope, schema: S.Schema, label: str, keys: list[Column], row: Column, rows: int) -> Value:
        """A field's value in one row."""
        node = f.type
        if isinstance(node, S.Path) and len(node.parts) == 1 and node.parts[0] in self.schemas and node.parts[0] not in scope.fields:
            one, kind = self.nested(self.schemas[node.parts[0]], F.lit(1), scope, label, keys)
            return Value(F.try_element_at(one, F.lit(1)), kind)
        if isinstance(node, S.Many):
            n = F.floor(V.number(compiled(node.count, scope))).cast("int")
            n = F.when(n < 0, F.raise_error(F.lit(f"{label}.{f.name}: a collection can't have a negative size"))).otherwise(n)
            if isinstance(node.element, S.Path) and node.element.parts[0] in self.schemas:
                arr, kind = self.nested(self.schemas[node.element.parts[0]], n, scope, f"{label}.{f.name}", keys)
                return Value(arr, T.ArrayType(kind))
            start = self.labels
            t = compiled(node.element, replace(scope, draw=self.drawer([*keys, F.lit(0)], label))).type

            def one_of(i: Column) -> Column:
                self.labels = start
                return compiled(node.element, replace(scope, draw=self.drawer([*keys, i], label))).column

            return Value(_mapped(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), one_of), T.ArrayType(t))
        if isinstance(node, S.AnyOf):
            return self.carried(node, f"{label}.{f.name}", keys)
        if isinstance(node, S.Cycle):
            options = [compiled(e, scope) for e in node.elements]
            t = V.common([o.type for o in options])
            return Value(F.element_at(F.array(*[V.to(o, t) for o in options]), (F.pmod(row, F.lit(len(options))) + 1).cast("int")), t)
        if f.distribution is not None and isinstance(f.distribution, S.Path) and f.distribution.parts[0] in self.distributions:
            buckets = self.distributions[f.distribution.parts[0]].buckets
            return compiled(S.Choice(tuple((w, S.Draw("int", None, b) if isinstance(b, S.Range) else b) for b, w in buckets)), scope)
        call = named_string(f.name, schema.name) if isinstance(node, S.Draw) and node.kind == "string" else None
        if f.unique and (v := self.unique(node, row, rows, f"{label}.{f.name}", keys, scope, S.Call(call, ()) if call else None)) is not None:
            return v
        if call:
            return compiled(S.Call(call, ()), scope)
        place = label if len(keys) > 2 else None
        scope.functions = scope.functions | {"sequence": lambda a, s: self.sequence(a, row, rows, True, place, keys[2:]), "sequenceInt": lambda a, s: self.sequence(a, row, rows, False, place, keys[2:])}
        return compiled(node, scope)

    def nested(self, schema: S.Schema, n: Column, scope: Scope, label: str, keys: list[Column]) -> tuple[Column, T.StructType]:
        if label.count(f"<{schema.name}>") > 3:
            raise CompileError(f"schema {schema.name} contains itself")
        numbers = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: F.struct(i.alias(NUMBER)))
        arr, kind = self.elements(numbers, T.StructType([T.StructField(NUMBER, T.IntegerType())]), self.fields(schema), schema, f"{label}<{schema.name}>", keys, scope, 0)
        private = {f.name for f in schema.fields if f.private and self.inside is None} | {NUMBER}
        shown = T.StructType([f for f in kind.fields if f.name not in private])
        mark = (self.counting or {}).get(f"{label}<{schema.name}>")
        extra = [T.StructField(mark, T.LongType())] if mark else []
        ones = [F.lit(1).cast("long").alias(mark)] if mark else []
        return F.transform(arr, lambda x: F.struct(*[x[f.name].alias(f.name) for f in shown.fields], *ones)), T.StructType([*shown.fields, *extra])

    def _nested(self, fields: list[S.Field], asked) -> bool:
        """Whether a field of a nested collection's rows is as asked for."""
        seen: set[str] = set()

        def nested(node: S.Node) -> bool:
            inner = node.element if isinstance(node, S.Many) else node
            name = inner.parts[0] if isinstance(inner, S.Path) else None
            if name not in self.schemas or name in seen:
                return False
            seen.add(name)
            return any(asked(f) or nested(f.type) for f in self.fields(self.schemas[name]))

        return any(nested(f.type) for f in fields)

    def numbered_inside(self, df: DataFrame, arr: Column, kind: T.StructType, marks: dict[str, str], rows: int) -> DataFrame:
        """``df`` with, for each place of a sequence in nested collections, the shape of the row's elements (nested arrays) and
        the number of elements in all rows before it."""

        def shape(c: Column, t: T.DataType, mark: str) -> Column | None:
            if isinstance(t, T.ArrayType):
                return F.transform(c, lambda x: shape(x, t.elementType, mark)) if shape(F.lit(None), t.elementType, mark) is not None else None
            if not isinstance(t, T.StructType):
                return None
            if mark in t.names:
                return c.getField(mark)
            return next((x for f in t.fields if (x := shape(c.getField(f.name), f.dataType, mark)) is not None), None)

        for place, mark in marks.items():
            own = shape(F.try_element_at(arr, F.lit(1)), kind, mark)
            if own is None:
                continue
            df = df.withColumn(mark, own)
            size = _leaves(F.col(mark), df.schema[mark].dataType)
            df = running.before_each(df, ROW, size, rows, f"{mark}_first")
            self.counted[place] = (f"{mark}_first", mark, df.schema[mark].dataType, df.agg(F.sum(size)).first()[0] or 0)
        return df

    def carried(self, node: S.AnyOf, place: str, keys: list[Column]) -> Value:
        """A reference inside a nested collection. Its draw is an ordinal that the row's keys alone decide; rows are looked up
        for all ordinals of a row at once (``looked_up_inside``) and found here in the row's map."""
        name = node.collection.parts[0]
        if name not in self.made:
            return V.literal(None)
        source = self.made[name]
        known = (place, name)
        if node.condition is not None and known not in self.picks:
            self.picks[known] = self.ordinals(source, node.condition)
        n = source.count if node.condition is None else self.picks[known][1]
        # while rows are made in turn, all attempts of a row share its references
        keys = keys if self.before is None else [keys[0], *keys[2:]]
        u = uniform(self.options.seed + self.salt * 1_000_003, f"{place}.any", *keys)
        at = F.floor(u * n).cast("long") if n else F.lit(None).cast("long")
        if self.inside is not None:
            mark = f"__at{list(self.inside).index(place) if place in self.inside else len(self.inside)}"
            self.inside[place] = (name, mark)
            return Value(F.struct(at.alias(mark)), T.StructType([T.StructField(mark, T.LongType())]))
        kind = source.shown().schema
        return Value(F.try_element_at(self.column(self.drawn_inside[place][1]), at), kind)

    def looked_up_inside(self, df: DataFrame, arr: Column, kind: T.StructType, keys: list[str]) -> DataFrame:
        """``df`` with a map of the referred rows by ordinal for each reference inside nested collections: the ordinals that
        a row draws are unnested, looked up by an equi-join and put together by row again."""

        def drawn(c: Column, t: T.DataType, mark: str) -> Column | None:
            """All ordinals of one mark in a value, or None if it holds none."""
            if isinstance(t, T.ArrayType):
                return F.flatten(F.transform(c, lambda x: drawn(x, t.elementType, mark))) if drawn(F.lit(None), t.elementType, mark) is not None else None
            if not isinstance(t, T.StructType):
                return None
            if t.names == [mark]:
                return F.array(c[mark])
            found = [x for f in t.fields if (x := drawn(c.getField(f.name), f.dataType, mark)) is not None]
            none = F.array().cast("array<bigint>")
            return F.concat(*[F.coalesce(F.filter(x, lambda v: v.isNotNull()), none) for x in found]) if found else None

        for place, (name, mark) in self.drawn_inside.items():
            ordinals = drawn(arr, T.ArrayType(kind), mark)
            if ordinals is None:
                df = df.withColumn(mark, F.lit(None).cast(T.MapType(T.LongType(), self.made[name].shown().schema)))
                continue
            asked = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.explode(F.array_distinct(ordinals)).alias("__ord_in"))
            shown = self.made[name].shown().columns
            side = self.made[name].frame.select(F.col(ROW).alias("__at"), F.struct(*[F.col(f"`{c}`") for c in shown]).alias("__found"))
            if (place, name) in self.picks:
                side = side.join(self.picks[place, name][0], F.col("__at") == F.col("__to")).select(F.col("__ord").alias("__at"), "__found")
            found = asked.join(side, F.col("__ord_in") == F.col("__at"))
            ks = [f"__k{i}" for i in range(len(keys))]
            maps = found.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("__ord_in", "__found"))).alias(mark))
            df = df.join(maps, [F.col(k) == F.col(x) for k, x in zip(keys, ks, strict=True)], "left").drop(*ks)
        return df

    def unique(self, node: S.Node, row: Column, rows: int, label: str, keys: list[Column], scope: Scope, plain: S.Node | None = None) -> Value | None:
        """A value of its own for each row: a permutation of the range or of the options, which wraps around when they run
        out; texts of other kinds carry their row's number. None for what can't repeat or can't be kept from it, with a
        warning if so."""
        if isinstance(node, S.Draw) and node.kind == "int" and node.within and isinstance(node.within.low, S.Literal) and isinstance(node.within.high, S.Literal):
            low, size = int(node.within.low.value), int(node.within.high.value) - int(node.within.low.value) + 1
        elif isinstance(node, S.Choice):
            low, size = 0, len(node.options)
        else:
            return self.unique_of(node, row, rows, label, scope, plain)
        if rows > size:
            self.warn(UNIQUE, f"{label}: {rows} rows have only {size} unique values")
        step = (int(size * 0.618) | 1) + 2 * (self.options.seed % 97)
        while gcd(step, size) != 1:
            step += 1
        shift = (self.options.seed * 7919 + 13) % size
        at = F.pmod(row.cast("long") * (step % size or 1) + shift, F.lit(size)).cast("long")
        if isinstance(node, S.Choice):
            options = [compiled(v, Scope(lets=self.lets, functions=REGISTRY)) for _, v in node.options]
            t = V.common([o.type for o in options])
            return Value(F.element_at(F.array(*[V.to(o, t) for o in options]), (at + 1).cast("int")), t)
        return Value(at + low, T.LongType())

    def unique_of(self, node: S.Node, row: Column, rows: int, label: str, scope: Scope, plain: S.Node | None) -> Value | None:
        """Unique decimals, dates, booleans, patterns and other texts."""
        within = node.within if isinstance(node, S.Draw) else None
        ends = [x.value if isinstance(x, S.Literal) else None for x in (within.low, within.high)] if within else [None, None]

        def permuted(size: int) -> Column:
            if rows > size:
                self.warn(UNIQUE, f"{label}: {rows} rows have only {size} unique values")
            return permutation(row, size, self.options.seed, label)

        if isinstance(node, S.Draw) and node.kind == "decimal" and (within is None or None not in ends):
            low, high = (0.0, 1000.0) if within is None else map(float, ends)
            places = node.precision if node.precision is not None else None if within else 2
            if places is None:  # each row has a stretch of the range to itself
                count = max(rows, 1)
                return Value((permutation(row, count, self.options.seed, label) + scope.uniform("decimal")) / count * (high - low) + low, T.DoubleType())
            first = ceil(round(low * 10**places, 6))
            return Value((permuted(floor(round(high * 10**places, 6)) - first + 1) + first) / float(10**places), T.DoubleType())
        if isinstance(node, S.Draw) and node.kind == "date" and (days := _days(ends if within else ["2020-01-01", None])) is not None:
            return Value(F.date_add(F.lit(days[0]).cast("date"), permuted(days[1]).cast("int")), T.DateType())
        if isinstance(node, S.Draw) and node.kind == "boolean":
            return Value(permuted(2) == 1, T.BooleanType())
        if isinstance(node, S.Call) and node.name in PATTERNS and (places := slots(PATTERNS[node.name](node.args))):
            # the last places, as many as a number can tell apart, are unique together; those before them are drawn
            size, k = 1, len(places)
            while k and size * len(places[k - 1]) <= 1 << 50:
                k -= 1
                size *= len(places[k])
            tail, n, parts = places[k:], permuted(size), []
            for x in reversed(tail):
                parts.append(F.substr(F.lit(x), (n % len(x) + 1).cast("int"), F.lit(1)))
                n = F.floor(n / len(x)).cast("long")
            head = [F.substr(F.lit(x), F.floor(scope.uniform("place") * len(x)).cast("int") + 1, F.lit(1)) for x in places[:k]]
            return Value(F.concat(*head, *reversed(parts)), T.StringType())
        if isinstance(node, S.Call) and node.name in ("sequence", "sequenceInt", "uuid", "faker.string.uuid"):
            return None
        v = compiled(plain or node, scope) if isinstance(node, S.Call | S.Draw) else None
        if v is None or v.kind != "string":
            self.warn(UNIQUE, f"{label}: values of this kind aren't kept from repeating")
            return None
        number = F.lower(F.conv(row.cast("string"), 10, 36))
        text = F.when(v.column.contains("@"), F.regexp_replace(v.column, F.lit("@"), F.concat(F.lit("."), number, F.lit("@")))).otherwise(F.concat(v.column, F.lit("-"), number))
        return Value(text, T.StringType())

    def sequence(self, args: tuple[S.Node, ...], row: Column, rows: int, text: bool, place: str | None = None, path: list[Column] = ()) -> Value:
        """Numbers counted on across the collections that use one name; inside nested collections, across the elements of all
        rows."""
        name, start = str(constant(args, 0, "")), int(constant(args, 1, 1))
        if place is not None and self.counting is not None:
            self.counting.setdefault(place, f"__in{len(self.counting)}")
        if place is not None and place in self.counted:
            first, shape, kind, rows = self.counted[place]
            row = self.column(first) + _before(self.column(shape), kind, path)
        key = (name, text)
        use = (key, len(self.made), place)  # of this collection, however often its expression is built
        if self.counting is not None:
            return Value(F.lit(name), T.StringType()) if text else Value(F.lit(0).cast("long"), T.LongType())
        if use not in self.sequences:
            self.sequences[use] = self.sequences.get(key, 0)
            self.sequences[key] = self.sequences[use] + rows
        n = row.cast("long") + start + self.sequences[use]
        return Value(F.concat(F.lit(name), n.cast("string")), T.StringType()) if text else Value(n, T.LongType())

    # -- changes to referenced rows

    def mutate(self, made: Made) -> None:
        """``then``: sums into and last writes onto the rows that a collection refers to, in one aggregate by their number
        and one join; values that read the referenced row see it after the sums where only the last one counts, or else all
        changes are made row by row, in order."""
        by_target: dict[str, list[S.Mutation]] = {}
        for m in made.schema.mutations:
            if len(m.target) != 2 or m.target[0] not in made.references:
                self.warn(TARGET, f"{made.schema.name}: {'.'.join(m.target)} isn't a field of a referenced row")
                continue
            by_target.setdefault(m.target[0], []).append(m)
        for ref, mutations in by_target.items():
            target = self.made[made.references[ref]]
            if _stepwise(ref, mutations):
                target.frame, target.changed = self.folded(made.frame, target.frame, ref, mutations), True
                continue
            scope = row_scope(made.frame.schema, self.lets, self.options.functions)
            sums, after = [], []
            for k, m in enumerate(mutations):
                own = names_in(m.value)
                if m.op == "+=" and ref not in own:
                    sums.append(F.sum(V.number(compiled(m.value, scope))).alias(f"__m{k}"))
                elif ref not in own:
                    v = compiled(m.value, scope)
                    sums.append(F.max_by(v.column, F.col(ROW)).alias(f"__m{k}"))
                else:
                    after.append((k, m))
                    extra = sorted(own - {ref} & set(made.frame.columns))
                    sums += [F.max_by(F.col(x), F.col(ROW)).alias(f"__x{k}_{x}") for x in extra if x in made.frame.columns]
            sums.append(F.count(F.lit(1)).alias("__touched"))
            changes = made.frame.where(F.col(f"__fk_{ref}").isNotNull()).groupBy(F.col(f"__fk_{ref}").alias("__to")).agg(*sums)
            df = target.frame.join(changes, F.col(ROW) == F.col("__to"), "left")
            order = target.frame.columns
            for k, m in enumerate(mutations):
                f = m.target[1]
                old = df.schema[f].dataType if f in df.columns else None
                if (k, m) in after:
                    fields = row_scope(df.schema, self.lets, self.options.functions).fields
                    whole = F.struct(*[F.col(f"`{c}`") for c in order])
                    inner = Scope({ref: Value(whole, T.StructType([df.schema[c] for c in order])), **{n.split("_", 3)[-1]: v for n, v in fields.items() if n.startswith(f"__x{k}_")}}, None, self.lets, None, REGISTRY)
                    v = compiled(m.value, inner)
                    new = V.number(compiled(S.Path((ref, f)), inner)) + V.number(v) if m.op == "+=" else v.column
                else:
                    new = F.coalesce(F.col(f).cast("double"), F.lit(0.0)) + F.col(f"__m{k}") if m.op == "+=" and f in df.columns else F.col(f"__m{k}")
                kind = old if old is not None and not (m.op == "+=" and isinstance(old, T.IntegralType)) else None
                new = new.cast(kind) if kind is not None else new.cast("long") if old is not None and isinstance(old, T.IntegralType) else new
                df = df.withColumn(f, F.when(F.col("__touched").isNotNull(), new).otherwise(F.col(f) if f in df.columns else None))
                order = order if f in order else [*order, f]
            target.frame = df.select(*order)
            target.changed = True

    def maps(self, rows: DataFrame, target: DataFrame, ref: str, mutations: list[S.Mutation]) -> dict[str, tuple[Column, Column, bool]] | None:
        """By changed field, what a referring row multiplies it by and adds to it, and whether the rate is always one; None
        where changes do anything else, or read changed fields other than their own."""
        changed = {m.target[1] for m in mutations}
        scope = row_scope(rows.schema, self.lets, self.options.functions)
        out: dict[str, tuple[Column, Column, bool]] = {}
        for m in mutations:
            f = m.target[1]
            paths = [n.parts for n in S.walk(m.value) if isinstance(n, S.Path) and n.parts[0] == ref]
            kind = target.schema[f].dataType if f in target.columns else None
            if any(len(x) < 2 or x[1] in changed - {f} or x[1] == f and len(x) > 2 for x in paths) or kind is not None and not isinstance(kind, T.NumericType):
                return None
            if any(x[1] not in changed for x in paths) and ref not in rows.columns:
                return None
            parts = running.linear(m.value, lambda n, f=f: isinstance(n, S.Path) and n.parts == (ref, f))
            if parts is None:
                return None
            rate, add = (compiled(x, scope) for x in parts)
            if m.op != "+=" and (isinstance(kind, T.IntegralType) and not (rate.whole and add.whole) or kind is None or add.kind not in ("number", "null")):
                return None
            one = parts[0] == S.Literal(0) if m.op == "+=" else parts[0] == S.Literal(1)
            made = (V.number(rate).cast("double") + (1 if m.op == "+=" else 0), V.number(add).cast("double"))
            out[f] = (*running.compose(out[f][:2], made), out[f][2] and one) if f in out else (*made, one)
        return out

    def composed(self, rows: DataFrame, target: DataFrame, ref: str, mutations: list[S.Mutation], maps: dict[str, tuple[Column, Column, bool]]) -> DataFrame:
        """``target`` after changes that are maps of one value: sums where all rates are one, or else compositions."""
        rows = rows.where(F.col(f"__fk_{ref}").isNotNull())
        names = {f: f"__m{k}" for k, f in enumerate(maps)}
        if all(one for _, _, one in maps.values()):
            changes = rows.groupBy(F.col(f"__fk_{ref}").alias("__to")).agg(*[F.sum(maps[f][1]).alias(f"{n}_add") for f, n in names.items()])
            changes = changes.withColumns({f"{n}_rate": F.lit(1.0) for n in names.values()})
        else:
            columns = [c.alias(f"{n}_{x}") for f, n in names.items() for x, c in zip(("rate", "add"), maps[f][:2], strict=True)]
            changes = running.composed(rows.select(F.col(f"__fk_{ref}").alias("__to"), ROW, *columns), "__to", ROW, list(names.values()))
        shown = target.columns
        df = target.join(changes, F.col(ROW) == F.col("__to"), "left")
        for f, n in names.items():
            old = F.col(f"`{f}`") if f in shown else F.lit(None).cast("double")
            new = F.coalesce(old.cast("double"), F.lit(0.0)) * F.col(f"{n}_rate") + F.col(f"{n}_add")
            kind = target.schema[f].dataType if f in shown else T.DoubleType()
            kind = T.LongType() if isinstance(kind, T.IntegralType) and any(m.op == "+=" for m in mutations if m.target[1] == f) else kind
            df = df.withColumn(f, F.when(F.col("__to").isNotNull(), new.cast(kind)).otherwise(old.cast(kind)))
        return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*shown, *names])])

    def folded(self, rows: DataFrame, target: DataFrame, ref: str, mutations: list[S.Mutation]) -> DataFrame:
        """``target`` after all changes of each referring row in turn. Changes that multiply and add are composed in parts.
        For others, the rows of one target are gathered, at most about FOLDED at once: a target with more takes them in
        several pieces, each from what the one before left. Only such targets are carried from piece to piece."""
        maps = self.maps(rows, target, ref, mutations)
        if maps is not None:
            return self.composed(rows, target, ref, mutations, maps)
        if (stopped := self.stopped(rows, target, ref, mutations)) is not None:
            return stopped
        to = f"__fk_{ref}"
        rows = rows.where(F.col(to).isNotNull())
        counts = rows.groupBy(to, F.floor(F.col(ROW) / FOLDED).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
        most = counts.groupBy(to).agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FOLDED:
            return self.fold_once(rows, target, ref, mutations)
        # chunks of row numbers are put together, in order, to pieces of at most twice FOLDED rows
        over = Window.partitionBy(to).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
        pieces = counts.withColumn("__piece", F.floor(F.coalesce(F.sum("__n").over(over), F.lit(0)) / FOLDED)).select(F.col(to).alias("__to"), "__c", "__piece")
        keys = [F.col(to) == F.col("__to"), F.floor(F.col(ROW) / FOLDED) == F.col("__c")]
        names, number = rows.columns, pieces.agg(F.max("__piece")).first()[0] + 1
        spark, at = rows.sparkSession, folder(rows.sparkSession, "then")
        rows.join(pieces, keys).select(*names, "__piece").repartition("__piece", to).write.partitionBy("__piece").parquet(f"{at}/rows")
        piece = lambda k: spark.read.schema(rows.schema).parquet(f"{at}/rows/__piece={k}")
        counts.groupBy(F.col(to).alias("__to")).agg(F.sum("__n").alias("n")).where(F.col("n") > FOLDED).select("__to").write.parquet(f"{at}/many")
        many = spark.read.schema(T.StructType([T.StructField("__to", rows.schema[to].dataType)])).parquet(f"{at}/many")
        carried = self.fold_once(piece(0).join(many, F.col(to) == F.col("__to"), "left_semi"), target.join(many, F.col(ROW) == F.col("__to"), "left_semi"), ref, mutations)
        for k in range(number):
            if k:
                carried = self.fold_once(piece(k), carried, ref, mutations)
            carried.write.parquet(f"{at}/target-{k}")
            carried = spark.read.schema(carried.schema).parquet(f"{at}/target-{k}")
        rest = target.join(many, F.col(ROW) == F.col("__to"), "left_anti")
        return self.fold_once(piece(0).join(many, F.col(to) == F.col("__to"), "left_anti"), rest, ref, mutations).unionByName(carried)

    def stopped(self, rows: DataFrame, target: DataFrame, ref: str, mutations: list[S.Mutation]) -> DataFrame | None:
        """``target`` after changes that add to one value up to a bound; None where changes do anything else."""
        m, f = mutations[0], mutations[0].target[1]
        kind = target.schema[f].dataType if f in target.columns else None
        stop = running.clamp(m.value, lambda n: isinstance(n, S.Path) and n.parts == (ref, f)) if len(mutations) == 1 and m.op != "+=" else None
        if stop is None or not isinstance(kind, T.DoubleType | T.LongType) or any(isinstance(n, S.Path) and n.parts[0] == ref and len(n.parts) < 2 for n in S.walk(stop[0])):
            return None
        if ref not in rows.columns and any(isinstance(n, S.Path) and n.parts[0] == ref for n in S.walk(stop[0])):
            return None
        add, law = compiled(stop[0], row_scope(rows.schema, self.lets, self.options.functions)), running.bounded(stop[2])
        if isinstance(kind, T.LongType) and not (add.whole and isinstance(stop[1], int)):
            return None
        rows = rows.where(F.col(f"__fk_{ref}").isNotNull())
        changes = rows.select(F.col(f"__fk_{ref}").alias("__to"), ROW, F.coalesce(V.number(add).cast("double"), F.lit(0.0)).alias("__m_add"), F.lit(float(stop[1])).alias("__m_bound"))
        changes = running.composed(changes, "__to", ROW, ["__m"], law).select("__to", F.struct(F.col("__m_add").alias("add"), F.col("__m_bound").alias("bound")).alias("__m"))
        df = target.join(changes, F.col(ROW) == F.col("__to"), "left")
        new = law.after(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.col("__m"))
        df = df.withColumn(f, F.when(F.col("__to").isNotNull(), new.cast(kind)).otherwise(F.col(f"`{f}`")))
        return df.select(*[F.col(f"`{c}`") for c in target.columns])

    def fold_once(self, rows: DataFrame, target: DataFrame, ref: str, mutations: list[S.Mutation]) -> DataFrame:
        """``target`` after the changes of ``rows``, which are gathered by target."""
        named = sorted({n for m in mutations for n in names_in(m.value)} & set(rows.columns) - {ref, ROW})
        changes = rows.groupBy(F.col(f"__fk_{ref}").alias("__to"))
        changes = changes.agg(F.sort_array(F.collect_list(F.struct(F.col(ROW), *[F.col(f"`{n}`") for n in named]))).alias("__rows"))
        shown = {f.name: f.dataType for f in target.schema.fields}
        kinds = dict(shown)

        def change(m: S.Mutation, state: dict[str, Column], row: Column) -> Value:
            whole = F.struct(*[state.get(c, F.col(f"`{c}`")).alias(c) for c in kinds])
            own = {n: Value(row.getField(n), rows.schema[n].dataType) for n in named}
            kind = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
            v = compiled(m.value, Scope({**own, ref: Value(whole, kind)}, None, self.lets, None, REGISTRY | self.options.functions))
            if m.op != "+=":
                return v
            f = m.target[1]
            old = F.coalesce(state[f].cast("double"), F.lit(0.0)) if f in state else F.lit(0.0)
            return Value(old + F.coalesce(V.number(v), F.lit(0.0)), T.DoubleType())

        fields = list(dict.fromkeys(m.target[1] for m in mutations))
        for m in mutations:
            f = m.target[1]
            if m.op == "+=" and isinstance(kinds.get(f), (T.IntegralType, type(None))):
                kinds[f] = T.DoubleType()
            elif f not in kinds:
                kinds[f] = change(m, {x: F.lit(None).cast(kinds[x]) for x in fields if x in kinds and x not in shown}, F.element_at("__rows", 1)).type

        def step(state: Column, row: Column) -> Column:
            now = {f: state.getField(f) for f in fields}
            for m in mutations:
                now[m.target[1]] = change(m, now, row).column.cast(kinds[m.target[1]])
            return F.struct(*[now[f].alias(f) for f in fields])

        start = F.struct(*[(F.col(f"`{f}`") if f in shown else F.lit(None)).cast(kinds[f]).alias(f) for f in fields])
        df = target.join(changes, F.col(ROW) == F.col("__to"), "left")
        df = df.withColumn("__end", F.when(F.col("__rows").isNotNull(), F.aggregate("__rows", start, step)))
        for f in fields:
            kind = T.LongType() if isinstance(shown.get(f), T.IntegralType) and any(m.op == "+=" for m in mutations if m.target[1] == f) else shown.get(f, kinds[f])
            old = F.col(f"`{f}`") if f in shown else F.lit(None)
            df = df.withColumn(f, F.when(F.col("__rows").isNotNull(), F.col("__end").getField(f).cast(kind)).otherwise(old.cast(kind)))
        return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*shown, *fields])])


def _stepwise(ref: str, mutations: list[S.Mutation]) -> bool:
    """Whether a value that reads the referenced row depends on more than sums and last writes made before it."""
    targets = [m.target[1] for m in mutations]
    readers = [ref in names_in(m.value) for m in mutations]
    for k, m in enumerate(mutations):
        if not readers[k]:
            continue
        paths = [n.parts for n in S.walk(m.value) if isinstance(n, S.Path) and n.parts[0] == ref]
        if m.op == "+=" or targets.count(targets[k]) > 1 or any(len(x) < 2 for x in paths):
            return True
        if any(targets[i] == x[1] and (i >= k or readers[i] or targets.count(x[1]) > 1) for x in paths for i in range(len(mutations))):
            return True
    return False


def _leaves(c: Column, kind: T.DataType) -> Column:
    """How many elements nested arrays (or one single value) hold."""
    if not isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), 1).otherwise(0).cast("long")
    if not isinstance(kind.elementType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(c, zero, lambda s, x: s + _leaves(x, kind.elementType)), zero)


def _before(c: Column, kind: T.DataType, path: list[Column]) -> Column:
    """How many elements of nested arrays stand before the one at a path of places."""
    if not isinstance(kind, T.ArrayType):
        return F.lit(0).cast("long")
    if not isinstance(kind.elementType, T.ArrayType):
        return path[0].cast("long")
    return _leaves(F.slice(c, 1, path[0]), kind) + _before(F.get(c, path[0]), kind.elementType, path[1:])


def _mapped(arr: Column, f) -> Column:
    """``transform`` of a function of one argument, whatever defaults it has besides."""
    return F.transform(arr, lambda x: f(x))


def _either(condition: Column, new: Value, old: Value | None) -> Value:
    if old is None:
        return Value(F.when(condition, new.column), new.type)
    t = V.common([new.type, old.type])
    return Value(F.when(condition, V.to(new, t)).otherwise(V.to(old, t)), t)


def generate(spark: SparkSession, source: str, seed: int = 0, strict: bool = False) -> dict[str, DataFrame]:
    """The collections of a description's datasets."""
    return Generator(spark, source, Options(seed, strict)).run()


def generate_file(spark: SparkSession, path: str, options: Options | None = None) -> dict[str, DataFrame]:
    """The collections of a description in a file, or in the files of a folder by name, anywhere Spark reads from. What it
    imports is looked for beside a local file."""
    from ..sources import openapi

    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("at")).orderBy("at")
    program, options = S.parse("\n".join(r["value"] for r in files.collect())), options or Options()
    if not options.imports and (local := Path(path)).exists():
        options = replace(options, imports=openapi.imports_of(program, str(local.parent)))
    return Generator(spark, program, options).run()
