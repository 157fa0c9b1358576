"""From profiles to descriptions: the text that ``parse`` reads back, and TypeScript interfaces."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.syntax import KEYWORDS
from .cells import typed
from .mine import Relation, mine
from .profile import FORMAT_GENERATORS, MOST_OPTIONS, NAME_GENERATORS, ColumnProfile, TableProfile, profile


def identifier(name: str) -> str:
    """A field name of the language: lower case, digits and single underscores; keywords get an underscore."""
    out = re.sub(r"[^a-zA-Z0-9_]", "", re.sub(r"[\s-]+", "_", name)).lower()
    out = re.sub(r"_+", "_", re.sub(r"^(\d)", r"_\1", out)).rstrip("_")
    out = out if re.match(r"^_\d", out) else out.lstrip("_")
    return f"{out}_" if out in KEYWORDS else out or "field"


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:].lower() for p in re.split(r"[-_\s]+", name) if p) or "Row"


def singular(name: str) -> str:
    if name.endswith("ies"):
        return name[:-3] + "y"
    if re.search(r"(ss|x|z|ch|sh)es$", name):
        return name[:-2]
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def _value(v: object) -> str:
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return f"{v:g}" if isinstance(v, float) else str(v)


def _number(x: float, places: int) -> str:
    return str(int(x)) if x == int(x) else f"{x:.{max(places, 1)}f}" if places <= 4 else repr(x)


@dataclass(frozen=True)
class Style:
    """Whether formats and names become generators, and options keep their weights; most options of an enumeration."""

    formats: bool = True
    weights: bool = True
    most_options: int = MOST_OPTIONS


def type_text(p: ColumnProfile, names: dict[str, str] | None = None, style: Style = Style()) -> str:
    """A field's type. Order of decisions: nested tables, unique fields, enumerations, names, formats, ranges."""
    unique = "unique " if p.unique else ""
    if p.type == "array":
        low, high = int(p.low or 0), int(p.high or 0)
        element = (names or {}).get(p.name, "string")
        return f"{low} of {element}" if low == high else f"{low}..{high} of {element}"
    if p.type == "object":
        return (names or {}).get(p.name, "string")
    if not p.unique and p.options and p.type != "date":
        if p.even or len(p.options) == 1 or not style.weights:
            return " | ".join(_value(v) for v, _ in p.options)
        return " | ".join(f"{round(n / p.present, 2):g}: {_value(v)}" for v, n in p.options)
    if p.type == "string" and style.formats:
        low = p.name.lower()
        if not (low == "id" or low.endswith("_id")) and (g := NAME_GENERATORS.get(low) or NAME_GENERATORS.get(p.name)):
            return g
        return FORMAT_GENERATORS.get(p.format or "", f"{unique}string")
    if p.type == "date":
        return f"date in {p.low}..{p.high}" if p.low is not None else "date"
    if p.type in ("int", "decimal") and p.low is not None:
        if p.low == p.high:
            return _number(p.low, p.places)
        if p.type == "int":
            return f"{unique}int in {int(p.low)}..{int(p.high)}"
        kind = f"decimal({p.places})" if 0 < p.places <= 4 else "decimal"
        return f"{unique}{kind} in {_number(p.low, p.places)}..{_number(p.high, p.places)}"
    return p.type if p.type in ("boolean", "int", "decimal") else f"{unique}string"


def structure(table: TableProfile, style: Style = Style()) -> tuple:
    """What tables must share to be described by one schema: names, types, nulls, options and generators of their fields, in
    any order, and the structures of nested ones. Ranges may differ."""

    def of(p: ColumnProfile) -> tuple:
        options = tuple(sorted(repr(v) for v, _ in p.options)) if p.options and not p.unique and p.type != "date" else None
        generator = type_text(p, None, style).removeprefix("unique ") if p.type == "string" and options is None else None
        return p.name, p.type, p.nullable, options, generator, structure(p.nested, style) if p.nested else None

    return tuple(sorted(map(of, table.columns), key=lambda x: x[0]))


def schema_text(name: str, table: TableProfile, relations: list[Relation] = (), taken: dict[tuple, str] | None = None, style: Style = Style()) -> list[str]:
    """The schema of a table and, before it, those of its nested tables; nested ones of equal structure are written once,
    under the first one's name."""
    out, names = [], {}
    taken = {} if taken is None else taken
    for p in table.columns:
        if p.nested:
            inner = pascal(singular(p.name))
            shape = structure(p.nested, style)
            if shape not in taken:
                *before, body = schema_text(inner, p.nested, (), taken, style)
                base, k = inner, 2
                while any(t == inner for t in taken.values()) or inner == name:
                    inner, k = f"{base}{k}", k + 1
                taken[shape] = inner
                out += [*before, body.replace(f"schema {base} ", f"schema {inner} ", 1)]
            names[p.name] = taken[shape]
    derived = {r.target: r.text for r in relations if r.kind not in ("ordering", "conditional")}
    lines = []
    for p in table.columns:
        text = derived.get(p.name) or type_text(p, names, style) + ("?" if p.nullable and not p.options else "")
        lines.append(f"  {identifier(p.name)}: {text}")
    rules = [f"  {r.text}" for r in relations if r.kind in ("ordering", "conditional")]
    body = ",\n".join(lines) + ("," if rules and lines else "") + ("\n\n" + "\n".join(rules) if rules else "")
    return [*out, f"schema {name} {{\n{body}\n}}"]


def describe(frames: dict[str, DataFrame], dataset: str = "Generated", relations: bool = True, exact: bool = True, style: Style = Style()) -> str:
    """A description of tables: a schema each, with the relations mined from it, and a dataset of their sizes."""
    texts, entries, taken = [], [], {}
    for name, df in frames.items():
        table = profile(df, exact, most_options=style.most_options)
        enums = {p.name: [v for v, _ in p.options] for p in table.columns if p.options}
        schema = pascal(singular(name))
        texts += schema_text(schema, table, mine(df, enums) if relations else (), taken, style)
        entries.append(f"  {identifier(name)}: {table.rows} of {schema}")
    return "\n\n".join([*texts, f"dataset {dataset} {{\n" + ",\n".join(entries) + "\n}"]) + "\n"


def describe_one(df: DataFrame, name: str = "rows") -> str:
    """Only the schema of one table."""
    return "\n\n".join(schema_text(pascal(singular(name)), profile(df)))


def describe_json(df: DataFrame, column: str, name: str = "rows") -> str:
    """The schema of a column of JSON objects, whose cells may be of several types."""
    return "\n\n".join(schema_text(pascal(singular(name)), profile(typed(df, column))))


def _typescript(p: ColumnProfile, names: dict[str, str]) -> str:
    if p.type == "array":
        return f"{names.get(p.name, 'unknown')}[]"
    if p.type == "object":
        return names.get(p.name, "Record<string, unknown>")
    if p.options and p.type == "string":
        return " | ".join(_value(v) for v, _ in p.options)
    return {"int": "number", "decimal": "number", "boolean": "boolean"}.get(p.type, "string")


def typescript(name: str, table: TableProfile) -> str:
    """Interfaces of a table and its nested tables."""
    out, names, lines = [], {}, []
    for p in table.columns:
        if p.nested:
            names[p.name] = pascal(singular(p.name))
            out.append(typescript(names[p.name], p.nested))
        key = p.name if re.match(r"^[A-Za-z_$][\w$]*$", p.name) else f'"{p.name}"'
        lines.append(f"  {key}{'?' if p.nullable else ''}: {_typescript(p, names)};")
    return "\n\n".join([*out, f"export interface {name} {{\n" + "\n".join(lines) + "\n}"])
