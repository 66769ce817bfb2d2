"""What rounds report: a table of tasks, its roll-up, splits that were counted twice, and a text with the tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import FrameReport

SCHEMA = "round int, rerun int, operator string, level int, node int, records long, bytes long, start_ms long, dur_ms long, host string, error string"


def metrics(spark: SparkSession, reports: Sequence[FrameReport]) -> DataFrame:
    """A row for every task of every round."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(line[n] for n in names) for r in reports for line in r.log], SCHEMA)


def rollup(table: DataFrame) -> DataFrame:
    """Totals of each round and operator over tasks that did not fail."""
    return table.where("error IS NULL").groupBy("round", "operator").agg(F.count("*").alias("tasks"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.max("dur_ms").alias("slowest_ms"))


def duplicate_splits(table: DataFrame, round_col: str = "round", split_col: str = "node") -> DataFrame:
    """(round, split, times) of splits whose results stand in a round more than once."""
    return table.groupBy(F.col(round_col).alias("round"), F.col(split_col).alias("split")).agg(F.count("*").alias("times")).where("times > 1")


def tree_text(levels: Sequence[int], splits: int) -> str:
    """The aggregation tree as text: its root first, the map tasks last."""
    rows = [("update", 1), *((f"reduce {k}", n) for k, n in reversed([*enumerate(levels, 1)])), ("map", splits)]
    return "\n".join("  " * depth + f"+- {name} x{n}" for depth, (name, n) in enumerate(rows))


def format_frames(reports: Sequence[FrameReport]) -> str:
    """A text for each round: time, records, tries, failed splits, splits counted twice, and the tree that ran."""
    out = []
    for r in reports:
        maps = [x for x in r.log if x["operator"] == "map"]
        good = [x["node"] for x in maps if not x["error"] and x["rerun"] == max(y["rerun"] for y in maps)]
        twice = sorted({n for n in good if good.count(n) > 1})
        failed = sorted({x["node"] for x in maps if x["error"]})
        out.append(f"round {r.round}: {r.seconds:.2f} s, {sum(x['records'] for x in maps)} records, {sum(x['bytes'] for x in maps)} bytes, {r.attempts} attempts" + (f", failed: {failed}" if failed else "") + (f", twice: {twice}" if twice else ""))
        out.append(tree_text(r.levels, len({x["node"] for x in maps})))
    return "\n".join(out)
