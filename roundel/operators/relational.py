"""Counts, folds and exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_count(df: DataFrame, key: str, method: str = "hash") -> DataFrame:
    """Rows of each key. hash and external are one hash aggregation, which spills by itself.

    sort counts first, within each task and then by key, and sorts the counts: a hot key moves a row for
    each task, and the result comes in the order of the key.
    """
    if method == "sort":
        return external_sort(df.groupBy(key).agg(F.count("*").alias("n")), [key])
    if method not in ("hash", "external"):
        raise ValueError(f"unknown method {method!r}")
    return df.groupBy(key).agg(F.count("*").alias("n"))


def external_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of the keys: ranges of about equal size, each sorted by one task, which spills by itself."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def merge_exchange(df: DataFrame, key: Column, n: int, order: Sequence[str]) -> DataFrame:
    """Rows dealt out to n partitions by a hash of the key, each partition in order: a sorted merge of what its senders give."""
    return df.repartition(n, key).sortWithinPartitions(*order)


def spread_exchange(df: DataFrame, target: Column, n: int) -> DataFrame:
    """Every row to the partition that it names itself."""
    return df.repartitionById(n, target.cast("int"))


def word_count(tokens: DataFrame, array: str = "tokens") -> DataFrame:
    return tokens.select(F.explode(array).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "") -> DataFrame:
    """The texts of each group in order, joined; null texts are left out. The result is one value, so a group's texts meet in one task."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"])
    return df.groupBy(*keys).agg(F.array_join(parts, sep).alias("joined"), F.count("*").alias("n"))


def vector_sum(df: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """Element-wise sums: (keys, pos, total)."""
    return df.select(*keys, F.posexplode(array).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum(F.col("v").cast("double")).alias("total"))


def with_bucket(df: DataFrame, bucket: Column, n: int) -> DataFrame:
    """Rows dealt out by a bucket number of one's own."""
    return df.withColumn("bucket", F.pmod(bucket, F.lit(n))).repartition(n, "bucket")


def summaries(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """sum, count, the row of the smallest value and the last value by order."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.min(F.struct(value, order))[order].alias("arg_min"), F.max(F.struct(order, value))[value].alias("last_value"))
