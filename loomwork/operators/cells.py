"""Types of single cells in columns of JSON, whose values may be of several types.

Texts are parsed to VARIANT, objects are unnested to one row for each key and value, and each value gets the tag of its own
type. Tags are counted by key in one partial aggregate; what type a column is to have follows from its counts. Columns are
then taken out of the objects with these types, so that all that works on plain columns works on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that are dates, or dates with a time.
DATE = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-4]):[0-5]\d:[0-5]\d.*)?$"
#: Tags in the order in which a column of several takes one.
TAGS = ("null", "boolean", "int", "decimal", "date", "string", "array", "object")


@dataclass
class Cells:
    """A key of the objects: how many of its cells have which tag. Rows without the key count as null."""

    name: str
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def nullable(self) -> bool:
        return bool(self.counts.get("null"))

    @property
    def mixed(self) -> bool:
        return len(set(self.counts) - {"null"}) > 1

    @property
    def type(self) -> str:
        return common_type(self.counts)


def common_type(tags) -> str:
    """One type for cells of several: arrays before objects before all else, whole numbers among decimals are decimals, and
    anything else mixed is text."""
    kinds = set(tags) - {"null"}
    for first in ("array", "object"):
        if first in kinds:
            return first
    if kinds == {"int", "decimal"}:
        return "decimal"
    return next(iter(kinds)) if len(kinds) == 1 else "string" if kinds else "null"


def variants(c: Column, kind: T.DataType) -> Column:
    """A column of JSON texts as VARIANT (null where a text isn't JSON)."""
    return c if isinstance(kind, T.VariantType) else F.try_parse_json(c)


def tag(value: Column) -> Column:
    """The tag of a variant. A number without a fraction is whole, however it is written."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = (kind == "BIGINT") | (number == F.rint(number))
    return (
        F.when(value.isNull() | (kind == "VOID"), "null").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("DATE") | kind.startswith("TIMESTAMP"), "date").when(kind == "STRING", F.when(F.try_variant_get(value, "$", "string").rlike(DATE), "date").otherwise("string"))
        .when(whole, "int").otherwise("decimal")
    )


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """``key``, ``tag`` and ``n`` for the cells of a column's objects. Rows that hold no object have no cells."""
    rows = df.select(variants(F.col(column), df.schema[column].dataType).alias("__v"))
    rows = rows.where(F.schema_of_variant("__v").startswith("OBJECT"))
    cells = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    return cells.groupBy("key", tag(F.col("value")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def cells_of(df: DataFrame, column: str) -> list[Cells]:
    """The keys of a column's objects, by name. One row for each key and tag reaches the driver."""
    rows = df.count()
    found: dict[str, Cells] = {}
    for r in tag_counts(df, column).orderBy("key", "tag").collect():
        found.setdefault(r["key"], Cells(r["key"])).counts[r["tag"]] = r["n"]
    for c in found.values():
        if lacking := rows - sum(c.counts.values()):
            c.counts["null"] = c.counts.get("null", 0) + lacking
    return list(found.values())


def _path(key: str) -> str:
    for quote in ('"', "'"):
        if quote not in key:
            return f"$[{quote}{key}{quote}]"
    raise ValueError(f"the key {key!r} holds both kinds of quotes")


def typed(df: DataFrame, column: str, found: list[Cells] | None = None) -> DataFrame:
    """The keys of a column's objects as columns of their common types: of nested values, the type that all of them share."""
    found = cells_of(df, column) if found is None else found
    if not found:
        return df.select()
    rows = df.select(variants(F.col(column), df.schema[column].dataType).alias("__v"))
    plain = {"boolean": "boolean", "int": "bigint", "decimal": "double", "date": "string", "string": "string", "null": "string"}
    nested = [c for c in found if c.type not in plain]
    kinds: dict[str, str] = {}
    if nested:
        # cells of other types are no part of the nested type
        of = lambda c: F.try_variant_get("__v", _path(c.name), "variant")
        told = rows.agg(*[F.schema_of_variant_agg(F.when(tag(of(c)) == c.type, of(c))).alias(f"k{i}") for i, c in enumerate(nested)]).first()
        kinds = {c.name: told[i].replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") for i, c in enumerate(nested)}
    return rows.select(*[F.try_variant_get("__v", _path(c.name), kinds.get(c.name) or plain[c.type]).alias(c.name) for c in found])
