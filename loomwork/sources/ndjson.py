"""Newline-delimited JSON: plain rows, and rows of several collections in one stream."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import json_parts

#: ``name: {...}`` on a line.
PREFIX = r"(?s)\A([^{]+?): (\{.*)\z"
COLLECTION = "_collection"


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object for each line that isn't blank."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, joined: bool = False) -> dict[str, DataFrame]:
    """A file with one object of arrays: a collection for each. Arrays of objects are read in parts (``json_parts``); only
    files that hold other arrays too are read whole. ``joined``: the files of a folder are one document (``write_document``)."""
    found = json_parts.read_parts(spark, path, joined)
    if found is not None:
        return found
    if joined:
        raise ValueError(f"{path} holds arrays of anything but objects, which are read from one file only")
    whole = spark.read.option("multiLine", True).json(path)
    out = {}
    for f in whole.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            rows = whole.select(F.explode(f.name).alias("x"))
            out[f.name] = rows.select("x.*") if isinstance(f.dataType.elementType, T.StructType) else rows.select(F.col("x").alias("value"))
    return out


def collection_of(line: Column) -> Column:
    """The collection that a line belongs to: its prefix, its ``_collection`` key, or ``default``."""
    prefix = F.regexp_extract(line, PREFIX, 1)
    key = F.get_json_object(F.when(prefix == "", line), f"$.{COLLECTION}")
    return F.when(prefix != "", prefix).otherwise(F.coalesce(key, F.lit("default")))


def body_of(line: Column) -> Column:
    """The JSON text of a line, without a prefix."""
    body = F.regexp_extract(line, PREFIX, 2)
    return F.when(body != "", body).otherwise(line)


def split_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``collection`` and ``body`` of lines of text, blank ones left out."""
    c = F.col(column)
    return lines.where(F.trim(c) != "").select(collection_of(c).alias("collection"), body_of(c).alias("body"))


def read_collections(spark: SparkSession, path: str, schemas: dict[str, T.StructType | str] | None = None) -> dict[str, DataFrame]:
    """The collections of a stream of lines; a schema that isn't given is inferred from that collection's lines."""
    rows = split_lines(spark.read.text(path))
    names = sorted(schemas) if schemas else [r[0] for r in rows.select("collection").distinct().collect()]
    out = {}
    for name in names:
        body = rows.where(F.col("collection") == name).select("body")
        schema = (schemas or {}).get(name)
        if schema is None:
            df = spark.read.json(body.rdd.map(lambda r: r[0]))
        else:
            df = body.select(F.from_json("body", schema).alias("x")).select("x.*")
        out[name] = df.drop(COLLECTION)
    return out


def line_of(df: DataFrame, collection: str | None = None, prefix: bool = False) -> DataFrame:
    """Rows as one line of JSON each in ``value``: plain, with a ``_collection`` key first, or with a name before."""
    fields = [F.col(f"`{n}`") for n in df.columns]
    if collection is None:
        return df.select(F.to_json(F.struct(*fields)).alias("value"))
    if prefix:
        return df.select(F.concat(F.lit(f"{collection}: "), F.to_json(F.struct(*fields))).alias("value"))
    return df.select(F.to_json(F.struct(F.lit(collection).alias(COLLECTION), *fields)).alias("value"))


def write_ndjson(frames: dict[str, DataFrame], path: str, include: bool = False, prefix: bool = False) -> None:
    """All collections into one folder of text files."""
    parts = [line_of(df, name if include or prefix else None, prefix) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.mode("overwrite").text(path)


def write_by_collection(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_json(frames: dict[str, DataFrame], folder: str, pretty: bool = False) -> None:
    """A folder of JSON rows for each collection; with ``pretty``, each row over several indented lines."""
    for name, df in frames.items():
        if pretty:
            df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"}).alias("value")).write.text(f"{folder}/{name}")
        else:
            df.write.json(f"{folder}/{name}")


def write_document(frames: dict[str, DataFrame], folder: str) -> None:
    """One document, an object with an array of objects for each collection, as the files of a folder: put together in order of
    their paths they are the document. Each ends at a brace, and each task writes its own rows. An array begins with its least
    row, as what stands before the first row differs from what stands before the others; the others come in any order."""
    brace = {"lineSep": "}"}
    text, k = "{", 0
    for i, (name, df) in enumerate(frames.items()):
        spark, rows = df.sparkSession, line_of(df)
        text += (", " if i else "") + json.dumps(name, ensure_ascii=False) + ": ["
        first = rows.agg(F.min("value")).first()[0]
        if first is not None:
            spark.range(1).select(F.lit((text + first)[:-1])).coalesce(1).write.options(**brace).text(f"{folder}/{k:05d}")
            copies = spark.range(rows.where(F.col("value") == first).count() - 1).select(F.lit(first).alias("value"))
            others = rows.where(F.col("value") > first).unionByName(copies)
            others.select(F.concat(F.lit(","), F.expr("substring(value, 1, length(value) - 1)"))).write.options(**brace).text(f"{folder}/{k + 1:05d}")
            text, k = "", k + 2
        text += "]"
    spark.range(1).select(F.lit(text)).coalesce(1).write.options(**brace).text(f"{folder}/{k:05d}")
