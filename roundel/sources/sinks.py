"""Sinks: text lines, delimited files, rebalanced files, models."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str, key: str = "word", count: str = "n") -> None:
    """A line `count<TAB>key` for each row."""
    counts.select(F.concat_ws("\t", F.col(count).cast("string"), F.col(key)).alias("value")).write.text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.csv(path, sep=sep)


def rebalance(lines: DataFrame, path: str, files: int, compression: str | None = None, seed: int = 0) -> None:
    """The lines in exactly so many files of about equal size; a line's file follows from its text and seed, ties spread by place."""
    key = F.pmod(F.xxhash64("value", F.monotonically_increasing_id(), F.lit(seed)), F.lit(files)).cast("int")
    writer = lines.select("value").repartitionById(files, key).write
    (writer.option("compression", compression) if compression else writer).text(path)


def save_model(spark: SparkSession, model: Mapping[str, object], directory: str, name: str, round_: int, compressed: bool = False) -> None:
    """The model after a round as one JSON value in `directory/name-iter<round>`."""
    writer = spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite")
    (writer.option("compression", "gzip") if compressed else writer).text(f"{directory}/{name}-iter{round_}")


def load_model(spark: SparkSession, directory: str, name: str, round_: int) -> dict[str, object]:
    return json.loads(spark.read.text(f"{directory}/{name}-iter{round_}").first()[0])


def generate(spark: SparkSession, path: str, splits: int, make: Callable[[int], Iterable[str]], compression: str | None = None) -> None:
    """A file of lines for each split, written by a task of its own; make(split) gives the lines and may be run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.column("id").to_pylist():
                lines = iter(make(split))
                while part := list(islice(lines, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"])

    writer = spark.range(0, splits, 1, splits).mapInArrow(run, "value string").write
    (writer.option("compression", compression) if compression else writer).text(path)


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="roundel-")
        context.setCheckpointDir(base)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and its lineage cut, in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)
