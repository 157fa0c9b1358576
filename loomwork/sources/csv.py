"""CSV in and out: typed cells, nested values as dotted columns, sorted headers."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 9007199254740991


@dataclass(frozen=True)
class Reading:
    delimiter: str = ","
    header: bool = True
    infer: bool = True


def cell_type(c: Column) -> Column:
    """What a cell is: null, boolean, int, decimal or string."""
    low = F.lower(c)
    whole = c.rlike(r"\A-?[0-9]+\z")
    return (
        F.when(c.isNull() | (c == "") | (low == "null"), "null")
        .when(low.isin("true", "yes", "false", "no"), "boolean")
        .when(whole & (F.abs(c.try_cast("decimal(38,0)")) <= SAFE), "int")
        .when(c.rlike(r"\A-?[0-9]+\.[0-9]+\z"), "decimal")
        .otherwise("string")
    )


def column_types(df: DataFrame) -> dict[str, str]:
    """The type of each string column, from the kinds of all of its cells: one pass, one row a task."""
    kinds = ("boolean", "int", "decimal", "string")
    sums = [F.count_if(cell_type(F.col(f"`{n}`")) == k).alias(f"{i}_{k}") for i, n in enumerate(df.columns) for k in kinds]
    got = df.agg(*sums).first()
    out = {}
    for i, n in enumerate(df.columns):
        seen = {k for k in kinds if got[f"{i}_{k}"]}
        out[n] = "string" if not seen or "string" in seen or "boolean" in seen and len(seen) > 1 else "boolean" if seen == {"boolean"} else "decimal" if "decimal" in seen else "int"
    return out


def typed(c: Column, kind: str) -> Column:
    value = F.when((c == "") | (F.lower(c) == "null"), None).otherwise(c)
    if kind == "boolean":
        return F.lower(value).isin("true", "yes")
    return value.try_cast({"int": "bigint", "decimal": "double"}[kind]) if kind in ("int", "decimal") else value


def read_csv(spark: SparkSession, path: str, how: Reading | None = None) -> DataFrame:
    """Rows of CSV files: quoted fields may hold line ends and doubled quotes, blank lines are left out, missing cells
    are null. Without a header columns are ``column_1`` and on."""
    how = how or Reading()
    df = (
        spark.read.option("sep", how.delimiter).option("header", how.header).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    )
    if not how.header:
        df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    kinds = column_types(df) if how.infer else dict.fromkeys(df.columns, "string")
    return df.select(*[typed(F.col(f"`{n}`"), kinds[n]).alias(n) for n in df.columns])


def read_csvs(spark: SparkSession, paths: dict[str, str], how: Reading | None = None) -> dict[str, DataFrame]:
    return {name: read_csv(spark, path, how) for name, path in paths.items()}


@dataclass(frozen=True)
class Writing:
    delimiter: str = ","
    header: bool = True
    arrays: str = "json"  # json, first or count
    nested: str = "flatten"  # flatten or json
    null: str = ""


def flattened(df: DataFrame, how: Writing | None = None) -> DataFrame:
    """String columns for every leaf, structs as dotted names, arrays as asked, sorted by name."""
    how = how or Writing()
    out: dict[str, Column] = {}

    def put(name: str, c: Column, t: T.DataType) -> None:
        if isinstance(t, T.StructType) and how.nested == "flatten":
            for f in t.fields:
                put(f"{name}.{f.name}", c.getField(f.name), f.dataType)
            return
        if isinstance(t, (T.StructType, T.MapType)) or isinstance(t, T.ArrayType) and how.arrays == "json":
            text = F.to_json(c)
        elif isinstance(t, T.ArrayType):
            first = F.try_element_at(c, F.lit(1))
            text = F.size(c).cast("string") if how.arrays == "count" else F.to_json(first) if isinstance(t.elementType, (T.StructType, T.ArrayType)) else first.cast("string")
            text = F.when(c.isNotNull(), text)
        else:
            text = c.cast("string")
        out[name] = F.coalesce(text, F.lit(how.null))

    for f in df.schema.fields:
        put(f.name, F.col(f"`{f.name}`"), f.dataType)
    return df.select(*[out[n].alias(n) for n in sorted(out)])


def write_csv(df: DataFrame, path: str, how: Writing | None = None) -> None:
    how = how or Writing()
    flattened(df, how).write.option("sep", how.delimiter).option("header", how.header).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_csvs(frames: dict[str, DataFrame], path: str, how: Writing | None = None) -> dict[str, str]:
    """Each collection in a folder of its own below ``path``; the folders by collection."""
    at = {name: f"{path.rstrip('/')}/{name}" for name in frames}
    for name, df in frames.items():
        write_csv(df, at[name], how)
    return at


def escaped(c: Column, delimiter: str = ",") -> Column:
    """A field as CSV text: quoted where it holds the delimiter, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.contains(delimiter) | c.contains('"') | c.contains("\n") | c.contains("\r"), quoted).otherwise(c)


def lines(df: DataFrame, how: Writing | None = None) -> DataFrame:
    """The rows as CSV text in one column ``value``."""
    how = how or Writing()
    flat = flattened(df, how)
    return flat.select(F.concat_ws(how.delimiter, *[escaped(F.col(f"`{n}`"), how.delimiter) for n in flat.columns]).alias("value"))


def write_sections(frames: dict[str, DataFrame], path: str, how: Writing | None = None) -> None:
    """All collections in one file of sections ``# name``, empty ones left out. One file is written by one process: rows
    come to it a partition at a time, so it holds no more than one."""
    how = how or Writing()
    with Path(path).open("w") as out:
        between = ""
        for name, df in frames.items():
            head = [how.delimiter.join(flattened(df, how).columns)] if how.header else []
            for i, r in enumerate(lines(df, how).toLocalIterator()):
                if i == 0:
                    out.write("\n".join([f"{between}# {name}", *head, ""]))
                    between = "\n"
                out.write(r[0] + "\n")
