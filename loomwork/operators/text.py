"""Markov chains of words or characters: counted over whole tables, walked row by row in equi-joins.

A chain is a table: a prefix of ``order`` units and the units that followed it, with running counts. Counting is one partial
aggregate. A walk looks each row's prefix up, once for each step, in a tree of its options.
Every draw is a hash of seed, row and step, so a walk depends on its row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import folder
from .generate import uniform

#: Options that a draw compares at once.
FAN = 64


def units(text: Column, characters: bool = False) -> Column:
    """The words between white space, or the characters, of a text."""
    return F.filter(F.split(text, "" if characters else r"\s+"), lambda x: x != "")


def transitions(df: DataFrame, text: str, order: int = 2, characters: bool = False) -> DataFrame:
    """``prefix`` (an array), ``next`` and ``n``: how often a unit follows a prefix in all texts. Texts of no more than
    ``order`` units, and nulls, have none."""
    if order < 1:
        raise ValueError("a prefix has one unit at least")
    u = F.col("u")
    places = F.when(F.size(u) > order, F.sequence(F.lit(1), F.size(u) - order))
    rows = df.select(units(F.col(text), characters).alias("u")).select("u", F.explode(places).alias("i"))
    rows = rows.select(F.slice(u, F.col("i"), F.lit(order)).alias("prefix"), F.element_at(u, F.col("i") + order).alias("next"))
    return rows.groupBy("prefix", "next").agg(F.count(F.lit(1)).alias("n"))


def chain_of(counts: DataFrame) -> DataFrame:
    """``prefix``, ``options`` (an array of ``next`` and ``upto``, the count up to and with it) and ``total``."""
    upto = F.sum("n").over(Window.partitionBy("prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
    entries = counts.withColumn("upto", upto).groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("upto", "next"))).alias("e"), F.sum("n").alias("total"))
    return entries.select("prefix", F.transform("e", lambda x: F.struct(x["next"].alias("next"), x["upto"].alias("upto"))).alias("options"), "total")


def _levels(chain: DataFrame) -> list[DataFrame]:
    """The chain as trees of at most FAN branches: the first table holds each prefix's top, the others what lies below, by
    prefix and branch. A draw compares FAN counts a level, however many options a prefix has."""
    spark, at = chain.sparkSession, folder(chain.sparkSession, "chain")
    cut = lambda o: F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / FAN).cast("int")), lambda k: F.slice(o, k * FAN + 1, FAN))
    first = chain.select(F.col("prefix").alias("__from"), "total", F.col("options").alias("o"))
    below: list[DataFrame] = []
    while True:
        first.write.parquet(f"{at}/top-{len(below)}")
        first = spark.read.schema(first.schema).parquet(f"{at}/top-{len(below)}")
        if (first.agg(F.max(F.size("o"))).first()[0] or 0) <= FAN:
            return [first, *below]
        parts = first.where(F.size("o") > FAN).select("__from", F.posexplode(cut(F.col("o"))).alias("branch", "o"))
        parts.write.parquet(f"{at}/below-{len(below)}")
        below.insert(0, spark.read.schema(parts.schema).parquet(f"{at}/below-{len(below)}"))
        tops = F.transform(cut(F.col("o")), lambda b: F.struct(F.lit(None).cast("string").alias("next"), F.element_at(b, -1)["upto"].alias("upto")))
        first = first.select("__from", "total", F.when(F.size("o") > FAN, tops).otherwise(F.col("o")).alias("o"))


def walk(rows: DataFrame, chain: DataFrame, steps: int, key: str, prefix: str = "prefix", seed: int = 0, out: str = "units") -> DataFrame:
    """``rows`` with ``out``: the units of their prefix and up to ``steps`` more, each drawn by its count; a walk ends early
    where nothing ever followed. Each step is written. It looks up only the prefixes that rows have reached: where all have
    reached a few, these are sent to the rows."""
    spark, at = rows.sparkSession, folder(rows.sparkSession, "walk")
    names = [c for c in rows.columns if c != out]
    rows = rows.select(*names, F.col(prefix).alias("__units"), F.col(prefix).alias("__at"))
    top, *below = _levels(chain)
    own = [*[F.col(f"`{n}`") for n in names], "__units", "__at"]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    rows = written(rows, "start")
    for k in range(steps):
        reached = rows.where(F.col("__at").isNotNull()).select(F.col("__at").alias("__from")).distinct()
        rows = rows.join(top.join(reached, "__from", "left_semi"), F.col("__at") == F.col("__from"), "left")
        rows = rows.withColumn("__spot", F.floor(uniform(seed, f"walk.{k}", F.col(key)) * F.col("total")))
        place = F.when(F.col("o").isNotNull(), F.size(F.filter("o", lambda o: o["upto"] <= F.col("__spot"))))
        rows = rows.withColumn("__branch", place)
        rows = rows.select(*own, "__spot", "__branch", F.try_element_at("o", F.col("__branch") + 1)["next"].alias("__new"))
        for table in below:
            # prefixes with fewer levels aren't in this one
            rows = rows.join(table, (F.when(F.col("__new").isNull(), F.col("__at")) == F.col("__from")) & (F.col("__branch") == F.col("branch")), "left")
            new = F.try_element_at("o", place + 1)["next"]
            rows = rows.select(*own, "__spot", F.coalesce(F.col("branch") * FAN + place, "__branch").alias("__branch"), F.coalesce("__new", new).alias("__new"))
        grown = F.concat("__units", F.array("__new"))
        moved = F.concat(F.slice("__at", F.lit(2), F.size("__at") - 1), F.array("__new"))
        there = F.col("__new").isNotNull()
        rows = written(rows.select(*own[: len(names)], F.when(there, grown).otherwise(F.col("__units")).alias("__units"), F.when(there, moved).alias("__at")), f"step-{k}")
    return rows.select(*own[: len(names)], F.col("__units").alias(out))
