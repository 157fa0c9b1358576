"""Checking external data against a description.

Row rules become one array column of errors per row, computed by generated code in a single narrow pass: no shuffle, and
only the columns that rules name are read. Rules over whole collections become one aggregate pass per collection; their
one-row results are put side by side for the comparisons.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.compiler import CompileError, Scope, compiled, row_scope
from ..functions.values import Value
from ..plans import syntax as S


def conjuncts(node: S.Node) -> list[S.Node]:
    """The sides of ``and``, reported separately; anything else is one rule."""
    if isinstance(node, S.Logical) and node.op == "and":
        return [*conjuncts(node.left), *conjuncts(node.right)]
    return [node]


@dataclass(frozen=True)
class Rule:
    """A rule of rows: its text, when it applies, and what must hold."""

    text: str
    node: S.Node
    condition: S.Node | None = None


def rules_of(schema: S.Schema) -> tuple[list[Rule], list[Rule]]:
    """The rules of a schema that can be checked, and those left out as they name private fields, which data lack."""
    private = {f.name for f in schema.fields if f.private}
    checked, skipped = [], []
    for assume in schema.assumes:
        for rule in assume.rules:
            for one in conjuncts(rule):
                names = {n.parts[0] for x in (one, assume.condition) if x is not None for n in S.walk(x) if isinstance(n, S.Path)}
                text = S.text_of(one) if assume.condition is None else f"if {S.text_of(assume.condition)}: {S.text_of(one)}"
                (skipped if names & private else checked).append(Rule(text, one, assume.condition))
    return checked, skipped


ERROR = T.StructType([T.StructField("rule", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("values", T.StringType())])


def _error(rule: Rule, scope: Scope) -> Column:
    """The error of a rule on a row, or null. A condition that can't be evaluated is an error itself."""
    names = sorted({n.parts[0] for x in (rule.node, rule.condition) if x is not None for n in S.walk(x) if isinstance(n, S.Path)} & set(scope.fields))
    shown = F.to_json(F.struct(*[scope.fields[n].column.alias(n) for n in names])) if names else F.lit("{}")
    make = lambda kind: F.struct(F.lit(rule.text).alias("rule"), F.lit(kind).alias("kind"), shown.alias("values"))
    holds = compiled(rule.node, scope)
    broken = ~V.truth(holds)
    out = F.when(holds.error, make("error")).when(broken, make("violation")) if holds.error is not None else F.when(broken, make("violation"))
    if rule.condition is None:
        return out
    applies = compiled(rule.condition, scope)
    guarded = F.when(V.truth(applies), out)
    return F.when(applies.error, make("error")).otherwise(guarded) if applies.error is not None else guarded


def holds(schema: S.Schema, scope: Scope) -> Column:
    """Whether a row satisfies every rule of a schema; a rule that can't be evaluated doesn't hold."""
    out = F.lit(True)
    for a in schema.assumes:
        for r in a.rules:
            v = compiled(r, scope)
            ok = V.truth(v) if v.error is None else V.truth(v) & ~v.error
            if a.condition is not None:
                c = compiled(a.condition, scope)
                ok = ~V.truth(c) | ok
                ok = ok if c.error is None else ok & ~c.error
            out = out & ok
    return out


@dataclass
class Report:
    valid: bool
    rows: int = 0
    failed: int = 0
    by_rule: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    missing: bool = False


class Checker:
    """The rules of a description, ready for DataFrames."""

    def __init__(self, source: str | S.Program):
        program = S.parse(source) if isinstance(source, str) else source
        self.schemas, self.datasets = program.all(S.Schema), program.all(S.Dataset)
        self.lets = {n: x.value for n, x in program.all(S.Let).items()}

    def _schema(self, name: str) -> S.Schema:
        if name not in self.schemas:
            raise KeyError(f"the description has no schema {name!r}")
        return self.schemas[name]

    def rows(self, df: DataFrame, schema: str, column: str = "errors", functions: dict | None = None) -> DataFrame:
        """``df`` with an array of the errors of each row: rule, kind (violation or error) and the values it saw. Rules may
        call further ``functions``."""
        checked, _ = rules_of(self._schema(schema))
        scope = row_scope(df.schema, self.lets, functions)
        found = [_error(r, scope) for r in checked]
        errors = F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast(T.ArrayType(ERROR))
        return df.withColumn(column, errors)

    def counts(self, df: DataFrame, schema: str) -> DataFrame:
        """A row for each rule: how many rows it was checked on and how many broke it, in one pass without a shuffle of
        rows (partial sums only)."""
        checked, _ = rules_of(self._schema(schema))
        scope = row_scope(df.schema, self.lets)
        sums = [F.count(_error(r, scope)).alias(f"r{i}") for i, r in enumerate(checked)]
        one = df.agg(F.count(F.lit(1)).alias("n"), *sums)
        entries = [F.struct(F.lit(r.text).alias("rule"), F.col("n").alias("rows"), F.col(f"r{i}").alias("broken")) for i, r in enumerate(checked)]
        return one.select(F.inline(F.array(*entries)))

    def violating(self, df: DataFrame, schema: str) -> DataFrame:
        """The rows that break some rule."""
        return df.where(~holds(self._schema(schema), row_scope(df.schema, self.lets)))

    def collection(self, df: DataFrame, schema: str) -> Report:
        checked, skipped = rules_of(self._schema(schema))
        errors = self.rows(df, schema)
        named = lambda t: F.exists("errors", lambda e: e["rule"] == t)
        sums = [F.coalesce(F.sum(named(r.text).cast("long")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(checked)]
        got = errors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.size("errors") > 0).cast("long")), F.lit(0)).alias("bad"), *sums).first()
        return Report(got["bad"] == 0, got["n"], got["bad"], {r.text: got[f"r{i}"] for i, r in enumerate(checked)}, [r.text for r in skipped])

    def dataset(self, frames: dict[str, DataFrame], mapping: dict[str, str] | None = None) -> dict[str, Report]:
        """A report for each collection of ``mapping`` (collection to schema; by name where it is not given). A collection
        that is missing is invalid."""
        mapping = mapping or self.mapping(list(frames))
        return {c: self.collection(frames[c], s) if c in frames else Report(False, missing=True) for c, s in mapping.items()}

    def mapping(self, collections: list[str]) -> dict[str, str]:
        """Collections to the schemas that their names mean: case, underscores and plurals aside."""
        plain = {n.replace("_", "").lower(): n for n in self.schemas}
        out = {}
        for c in collections:
            low = c.replace("_", "").lower()
            for form in (low, low[:-1] if low.endswith("s") else low, low[:-2] if low.endswith("es") else low, low[:-3] + "y" if low.endswith("ies") else low):
                if form in plain:
                    out[c] = plain[form]
                    break
        return out

    def whole(self, frames: dict[str, DataFrame], dataset: str) -> DataFrame:
        """A row for each rule of the dataset's ``validate`` block: its text, ``ok`` and ``failed`` (it couldn't be
        evaluated)."""
        rules = self.datasets[dataset].rules
        return dataset_rules(list(rules), frames, self.lets)

    def full(self, frames: dict[str, DataFrame], dataset: str, mapping: dict[str, str] | None = None) -> tuple[bool, dict[str, Report], list]:
        reports = self.dataset(frames, mapping)
        rules = self.whole(frames, dataset).collect() if dataset in self.datasets and self.datasets[dataset].rules else []
        return all(r.valid for r in reports.values()) and all(r["ok"] for r in rules), reports, rules


# -- rules over whole collections

_FOLDS = {"sum", "count", "min", "max", "avg", "first", "last", "median", "product"}


def dataset_rules(rules: list[S.Node], frames: dict[str, DataFrame], lets: dict[str, S.Node] | None = None) -> DataFrame:
    """``rule``, ``ok`` and ``failed`` of expressions over collections. Every aggregate that a rule names is taken in one
    pass over its collection; then one-row tables stand side by side, and nothing else is moved."""
    aggregates: dict[str, dict[str, Column]] = {c: {} for c in frames}
    types: dict[str, T.DataType] = {}

    def keep(collection: str, column: Column, t: T.DataType) -> Value:
        name = f"a{sum(map(len, aggregates.values()))}"
        aggregates[collection][name] = column.alias(name)
        types[name] = t
        return Value(F.col(name), t)

    def special(node: S.Node, scope: Scope) -> Value | None:
        if not isinstance(node, S.Call) or not node.args:
            return None
        first = node.args[0]
        if not isinstance(first, S.Path) or first.parts[0] not in frames:
            return None
        c = first.parts[0]
        df = frames[c]
        inner = row_scope(df.schema, lets)
        if node.name in ("all", "some", "none"):
            p = V.truth(compiled(node.args[1], inner))
            fold = F.coalesce(F.bool_and(p), F.lit(True)) if node.name == "all" else F.coalesce(F.bool_or(p), F.lit(False))
            v = keep(c, fold, T.BooleanType())
            return Value(~v.column, T.BooleanType()) if node.name == "none" else v
        if node.name not in _FOLDS:
            return None
        if len(first.parts) == 1:
            return keep(c, F.count(F.lit(1)), T.LongType()) if node.name == "count" else V.literal(0)
        v = compiled(S.Path(first.parts[1:]), inner)
        if node.name == "count":
            return keep(c, F.count(v.column), T.LongType())
        if node.name in ("first", "last"):
            by = F.col("_row") if "_row" in df.columns else F.monotonically_increasing_id()
            return keep(c, (F.min_by if node.name == "first" else F.max_by)(v.column, by), v.type)
        x = v.column.cast("double") if v.kind == "number" else V.null_of(T.DoubleType())
        fold = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "median": F.median, "product": F.product}[node.name]
        return keep(c, F.coalesce(fold(x), F.lit(0.0)), T.DoubleType())

    base = row_scope(T.StructType([]), lets)
    base.special = special
    outcomes = []
    for node in rules:
        try:
            v = compiled(node, base)
            failed = v.error if v.error is not None else F.lit(False)
            outcomes.append(F.struct(F.lit(S.text_of(node)).alias("rule"), (V.truth(v) & ~failed).alias("ok"), failed.alias("failed")))
        except CompileError:
            outcomes.append(F.struct(F.lit(S.text_of(node)).alias("rule"), F.lit(False).alias("ok"), F.lit(True).alias("failed")))
    sides = [frames[c].agg(*cols.values()) for c, cols in aggregates.items() if cols]
    spark = next(iter(frames.values())).sparkSession
    table = sides[0] if sides else spark.range(1)
    for s in sides[1:]:
        table = table.crossJoin(s)  # one row each
    return table.select(F.inline(F.array(*outcomes)))


# -- JSON Schema keywords

# Patterns of the named formats.
FORMATS = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$",
    "time": r"^\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "uuid": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "hostname": r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$",
    "ipv6": r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?$",
}
_KINDS = {"integer": "number", "number": "number", "string": "string", "boolean": "boolean", "array": "array", "object": "object"}


def deref(schema: dict, root: dict, depth: int = 0) -> dict:
    """``schema`` with its ``$ref`` replaced by what it names in ``root``; at most ten deep."""
    while "$ref" in schema and depth < 10:
        at = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            at = at.get(part, {})
        schema, depth = at, depth + 1
    return {} if "$ref" in schema else schema


def schema_errors(value: Value, schema: dict, path: str = "", root: dict | None = None, depth: int = 0) -> list[Column]:
    """A null or a (path, keyword) struct for each keyword that a value could break."""
    root = root or schema
    schema = deref(schema, root)
    c, out = value.column, []

    def unless(ok: Column, keyword: str) -> None:
        bad = c.isNotNull() & ~F.coalesce(ok, F.lit(False))
        out.append(F.when(bad, F.struct(F.lit(path or "/").alias("path"), F.lit(keyword).alias("keyword"))))

    want = schema.get("type")
    kind = "string" if value.kind == "date" else value.kind
    if want and kind not in ("null", _KINDS.get(want, kind)):
        unless(F.lit(False), "type")
        return out
    if want == "integer" and kind == "number" and not value.whole:
        unless(c == F.floor(c), "type")
    if "enum" in schema:
        unless(c.isin([x for x in schema["enum"] if x is not None]), "enum")
    if kind == "number":
        for key, ok in (("minimum", lambda b: c >= b), ("maximum", lambda b: c <= b), ("exclusiveMinimum", lambda b: c > b), ("exclusiveMaximum", lambda b: c < b)):
            if isinstance(schema.get(key), (int, float)) and not isinstance(schema.get(key), bool):
                unless(ok(schema[key]), key)
    if kind == "string":
        s = V.text(value)
        if "minLength" in schema:
            unless(F.length(s) >= schema["minLength"], "minLength")
        if "maxLength" in schema:
            unless(F.length(s) <= schema["maxLength"], "maxLength")
        if "pattern" in schema:
            unless(s.rlike(schema["pattern"]), "pattern")
        if schema.get("format") in FORMATS:
            unless(s.rlike(FORMATS[schema["format"]]), "format")
    if kind == "array" and "items" in schema and depth < 10:
        item = Value(F.lit(None), value.type.elementType)
        for k in range(len(schema_errors(item, schema["items"], f"{path}/*", root, depth + 1))):
            out.append(_first_of(c, value.type.elementType, k, schema["items"], f"{path}/*", root, depth))
    if kind == "object" and depth < 10:
        have = {f.name: f.dataType for f in value.type.fields}
        required = set(schema.get("required", []))
        for name, sub in schema.get("properties", {}).items():
            inner = Value(c.getField(name), have[name]) if name in have else V.literal(None)
            nullable = deref(sub, root).get("nullable", False)
            if name in required and not nullable:
                out.append(F.when(c.isNotNull() & inner.column.isNull(), F.struct(F.lit(f"{path}/{name}").alias("path"), F.lit("required").alias("keyword"))))
            if name in have:
                out += schema_errors(inner, sub, f"{path}/{name}", root, depth + 1)
    return out


def _first_of(array: Column, element: T.DataType, k: int, items: dict, path: str, root: dict, depth: int) -> Column:
    """The first error by the k-th keyword among an array's elements, or null."""
    found = F.transform(array, lambda x: schema_errors(Value(x, element), items, path, root, depth + 1)[k])
    return F.try_element_at(F.filter(found, lambda e: e.isNotNull()), F.lit(1))


def check_json_schema(df: DataFrame, schema: dict, root: dict | None = None, column: str = "errors") -> DataFrame:
    """``df`` with an array of (path, keyword) for what each row breaks of a JSON Schema; other columns are allowed."""
    whole = Value(F.struct(*[F.col(f"`{n}`") for n in df.columns]), df.schema)
    found = schema_errors(whole, schema, "", root)
    empty = F.array().cast("array<struct<path:string,keyword:string>>")
    return df.withColumn(column, F.filter(F.array(*found), lambda e: e.isNotNull()) if found else empty)


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` isn't in ``parent``: an anti-join, broadcast when the planner finds keys few."""
    return child.join(parent.select(F.col(parent_key).alias("__lw_key")).distinct(), child[key] == F.col("__lw_key"), "left_anti")
