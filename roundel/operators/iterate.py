"""The round loop: map a shared model over cached rows, reduce the partial results, update the model.

A job describes one round as DataFrame expressions; Catalyst plans it. What reaches the driver is one
row for each key of the reduced result, or, with flat aggregation, for each key and split.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.options import Options
from ..plans.shapes import choose, nary_levels
from ..sources.sinks import save_model


class RecoveryAction(Enum):
    ACCEPT = "accept"
    RERUN = "rerun"
    PARTIALLY_RERUN = "partially_rerun"


@dataclass
class Context:
    """What a job sees of its round."""

    round: int = 0
    attempt: int = 0
    model_age: int = 0
    splits: int = 0
    options: Options = field(default_factory=Options)


@dataclass
class Report:
    """One round: how long it took, the splits that count, tries, and the nodes of each level that ran (auto: one aggregation, as Catalyst plans it)."""

    round: int
    seconds: float
    attempts: int
    splits: list[int]
    levels: list[int]
    records: dict[int, int]


#: Folds by name, and what they are for two values in Python.
FOLDS = {"sum": lambda a, b: a + b, "min": min, "max": max, "bit_or": lambda a, b: a | b, "bit_and": lambda a, b: a & b, "bit_xor": lambda a, b: a ^ b, "bool_and": lambda a, b: a and b, "bool_or": lambda a, b: a or b}


class IterativeJob(ABC):
    keys: Sequence[str] = ()
    #: How each value column of a partial result is folded: a name in FOLDS. Jobs with a reduction of their own: frames.py.
    folds: dict[str, str] = {}

    @abstractmethod
    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        """Rows; a column `split` says which split each belongs to (else: its partition)."""

    @abstractmethod
    def map(self, rows: DataFrame, model: object, context: Context) -> DataFrame:
        """Rows with the key and value columns."""

    @abstractmethod
    def update(self, results: list[Row], model: object, context: Context) -> object: ...

    @abstractmethod
    def should_terminate(self, model: object, context: Context) -> bool: ...

    def on_failed(self, completed: set[int], context: Context) -> RecoveryAction:
        return RecoveryAction.RERUN

    def model_dict(self, model: object) -> dict:
        return dict(vars(model))

    def fold(self, rows: list[Row]) -> list[Row]:
        """Partial results with equal keys as one."""
        out: dict[tuple, dict] = {}
        for row in rows:
            d = row.asDict()
            have = out.setdefault(tuple(d[k] for k in self.keys), {})
            for c, f in self.folds.items():
                have[c] = d[c] if have.get(c) is None else have[c] if d[c] is None else FOLDS[f](have[c], d[c])
        return [Row(**dict(zip(self.keys, k, strict=True)), **v) for k, v in out.items()]

    integrate = fold


def fold_by(df: DataFrame, keys: Sequence[str], folds: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[getattr(F, f)(c).alias(c) for c, f in folds.items()])


def reduce_tree(partials: DataFrame, keys: Sequence[str], folds: dict[str, str], leaves: int, fan_in: int, split: str = "split") -> DataFrame:
    """Fold per-split results level by level, fan_in nodes at a time."""
    for _ in nary_levels(leaves, fan_in)[:-1]:
        partials = fold_by(partials.withColumn(split, F.floor(F.col(split) / fan_in)), [split, *keys], folds)
    return fold_by(partials, keys, folds)


def reduce_generic(partials: DataFrame, keys: Sequence[str], folds: dict[str, str], leaves: int, count: int, split: str = "split") -> DataFrame:
    """Contiguous ranges of splits to `count` reducers, then one."""
    return fold_by(fold_by(partials.withColumn(split, F.floor(F.col(split) * count / max(leaves, 1))), [split, *keys], folds), keys, folds)


def run(spark: SparkSession, job: IterativeJob, model: object, options: Options | None = None, max_attempts: int = 4) -> tuple[object, list[Report]]:
    """At least one round, until the job or max_rounds says stop. Returns the model and a report a round.

    When a round's Spark job fails, its splits are run in halves until those that fail are alone; the
    results of the others are kept, and the job's on_failed says how to go on. A round that fails
    max_attempts times raises what made it fail.
    """
    options = options or Options()
    rows = job.parse(spark, options)
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.spark_partition_id())
    if options.cache != "none":
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK if options.cache == "memory" else StorageLevel.DISK_ONLY)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    context = Context(splits=len(counts), options=options)
    reports, kind = [], choose(options.aggregation, len(counts))
    if options.aggregation == "auto" or kind == "none":
        levels = [1]
    else:
        levels = [options.agg_count, 1] if kind == "generic" else nary_levels(max(1, len(counts)), options.fan_in)
    try:
        if options.model_dir:
            save_model(spark, job.model_dict(model), options.model_dir, options.model_name, 0)
        while True:
            began = time.time()
            results, done = _round(job, rows, set(counts), model, context, max_attempts)
            model = job.update(results, model, context)
            reports.append(Report(context.round, time.time() - began, context.attempt + 1, sorted(done), levels, {s: counts[s] for s in done}))
            context.round, context.model_age, context.attempt = context.round + 1, context.model_age + 1, 0
            if options.model_dir:
                save_model(spark, job.model_dict(model), options.model_dir, options.model_name, context.round, context.round >= options.compress_after)
            if job.should_terminate(model, context) or options.max_rounds and context.round >= options.max_rounds:
                return model, reports
    finally:
        rows.unpersist()


def _tried(job: IterativeJob, rows: DataFrame, splits: set[int], everything: bool, model: object, context: Context) -> tuple[list[list[Row]], set[int], Exception | None]:
    """Results of the splits that can be computed, those splits, and why others can't."""
    try:
        return [_reduced(job, rows if everything else rows.where(F.col("split").isin(*splits)), model, context)], splits, None
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError) as e:
        if len(splits) < 2:
            return [], set(), e
        order, results, done, why = sorted(splits), [], set(), e
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            more, also, cause = _tried(job, rows, set(half), False, model, context)
            results, done, why = results + more, done | also, cause or why
        return results, done, why


def _round(job: IterativeJob, rows: DataFrame, splits: set[int], model: object, context: Context, max_attempts: int) -> tuple[list[Row], set[int]]:
    kept, done, todo = [], set(), splits
    while True:
        results, also, why = _tried(job, rows, todo, todo == splits, model, context)
        results, done_now = [r for part in results for r in part], done | also
        if len(also) == len(todo):
            break
        action = job.on_failed(done_now, context)
        if action is RecoveryAction.ACCEPT:
            break
        context.attempt += 1
        if context.attempt >= max_attempts:
            raise why
        if action is RecoveryAction.RERUN:
            kept, done, todo = [], set(), splits
        else:
            kept, done, todo = kept + results, done_now, splits - done_now
    merged = [*kept, *results]
    return (job.integrate(merged) if kept or why else merged), done_now


def _reduced(job: IterativeJob, rows: DataFrame, model: object, context: Context) -> list[Row]:
    options, keys = context.options, list(job.keys)
    mapped = job.map(rows, model, context)
    kind = choose(options.aggregation, context.splits)
    if options.aggregation == "auto":  # partial and final aggregation as Catalyst plans it
        return fold_by(mapped, keys, job.folds).collect()
    partials = fold_by(mapped, ["split", *keys], job.folds)
    if kind == "none":
        return job.fold(partials.collect())
    if kind == "generic":
        return reduce_generic(partials, keys, job.folds, context.splits, options.agg_count).collect()
    return reduce_tree(partials, keys, job.folds, context.splits, options.fan_in).collect()


def format_report(reports: Sequence[Report]) -> str:
    """A text table of the rounds, with the levels that ran from the root down."""
    out = []
    for r in reports:
        out.append(f"round {r.round}: {r.seconds:.2f} s, {len(r.splits)} splits, {sum(r.records.values())} records, {r.attempts} attempts")
        out += ["  " * k + f"level {k}: {n} nodes" for k, n in enumerate(reversed(r.levels))]
    return "\n".join(out)
