"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again.

1. language_id: documents without a letter, or whose most probable language has less than MIN_SCORE, go.
2. near_duplicates: of each group of linked documents the one with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret in a text is replaced by [SECRET], with all parts of entropy spans that overlap
   others; n_chars follows. No document goes.
5. pieces: the ids of each document, with the text they decode to.

A document with a null text goes in the first stage. Documents without words have no shingles and are
duplicates of nothing. Stages judge rows, not ids: of rows with one doc_id and different texts only those
that are copies or leaks go, of equal rows one stays, and rows without an id are judged like others
(of a group the smallest doc_id stays, a row without one only where none has one). A stage's table is
deleted when the next one stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundel.llm import decontamination, language_id, ngram_join, piece_codec, secret_scan
from roundel.llm.common import drop, read, row_hash, stored, unused

MIN_SCORE = 0.4
BROADCAST_ROWS = 1 << 20  # of an id and a hash each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.predict(docs, language_id.learn(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("row.*")


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the hash that, with doc_id, tells rows apart, and the name of its column."""
    name = unused(docs.columns, "row_hash")
    return docs.withColumn(name, row_hash(F.col("doc_id").cast("long"), F.col("text").cast("string"))), name


def _same(docs: DataFrame, name: str, marks: DataFrame) -> Column:
    return (docs[name] == marks["_hash"]) & docs["doc_id"].cast("long").eqNullSafe(marks["_doc"])


def _small(marks: DataFrame) -> DataFrame:
    """marks for a join, broadcast where they are few; else the documents are shuffled to them."""
    return F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.ngram_components(docs, more=True).where("n_shingles > 0")
    rows = groups.groupBy(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_hash")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    marks = stored(rows.where("NOT kept OR n > 1"), "duplicates")
    hashed, name = _hashed(docs)
    out = hashed.join(_small(marks), _same(hashed, name, marks), "left_anti")
    repeated = marks.where("kept")
    if not repeated.isEmpty():  # equal rows: one of them
        out = out.unionByName(hashed.join(repeated, _same(hashed, name, repeated), "left_semi").dropDuplicates(["doc_id", name]))
    return out.drop(name)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(docs, read(spark, sf_dir, "benchmark"))
    marks = stored(found.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_hash")).distinct(), "leaks")
    hashed, name = _hashed(docs)
    return hashed.join(_small(marks), _same(hashed, name, marks), "left_anti").drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs.columns, "found")
    found = secret_scan.scan_secrets(docs, whole=True, found=name)
    some = F.size(name) > 0
    clean = found.withColumn("text", F.when(some, secret_scan.redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", "text", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode),
]

#: A trained network and piece encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(docs)  # the table of the stage before
        docs = result
    return docs
