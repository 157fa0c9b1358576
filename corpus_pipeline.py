"""A corpus pipeline: language ID, SimHash near-dedup, mixing to target weights, SentencePiece encoding.

``STAGES`` are applied one after another, each to what the one before kept; a driver may write and reread the rows in
between. All stages but the last return the columns of ``documents``.

Defined results: nulls may stand in any column. Documents whose text is null, or holds no letter, have no language and go in
the first stage. Repeated rows and rows that share a doc_id are documents like others there; near-dedup then keeps one row
of each group of like texts, so that of repeated rows one stays, while unlike texts under one doc_id all stay; of the rows
with the group's smallest doc_id the one with the smallest text hash stays. In mixing, null languages and sources are leaves
of their own, and rows that share a doc_id in a leaf share one fate. An empty table gives an empty table at each stage.
Further columns stay with their rows, up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import langid, mixing, pieces, similar

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A language less sure than this is no language: with four of them, chance alone gives 0.25.
LEAST_SCORE = 0.3
#: The mix takes as many tokens as it is given; a leaf may be read twice.
MIX = mixing.Mix(budget=1000, max_epochs=2)


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with further columns under names of their own, so that no operator takes them for its own, and what gives
    all columns their names again."""
    names = {c: f"__further{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; those without a letter, or that fit none, go."""
    rows, shown = _apart(docs)
    net = langid.fit(rows, F.lit(True))
    seen = langid.identify(rows, net)
    return seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*shown)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near-copies."""
    rows, shown = _apart(docs)
    return similar.one_of_each(rows).select(*shown)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by domain, language and source to the target weights, once for each epoch."""
    rows, shown = _apart(docs)
    return mixing.mix(rows, MIX).select(*shown)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, and whether they decode to it again."""
    seen = pieces.encode(docs, decoded=True)
    return seen.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The network, the random bits and the pieces aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
