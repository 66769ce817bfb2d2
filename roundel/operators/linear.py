"""Linear models trained by whole-data gradients: perceptron and logistic regression.

Rows are (y, x array) or (y, ids, vals). The weights are broadcast as one vector, so a plan is the same
for ten dimensions and for millions. A round is one pass: every task multiplies whole batches with the
weights, sums its part of the gradient and gives a row for each dimension it has met, so what is
shuffled follows the number of tasks and not that of rows.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.options import Options
from .iterate import Context, IterativeJob


@dataclass
class LinearModel:
    weights: list[float]
    step: float = 1.0
    error: float = 100.0  # percent before the last step
    history: list[float] = field(default_factory=list)
    correct: int = 0
    total: int = 0


class LinearJob(IterativeJob):
    """kind:

    perceptron   g = sum of y x over mistakes; w += step * g / n; step *= 0.9
    logistic     d = (sigmoid(y w.x) - 1) y; w -= sum of d x (step 1, no mean)
    decay        p = sigmoid(w.x); w += 100 * 0.9**t * sum of (y01 - p) x / n
    threshold    as decay, only rows with |y01 - p| > 0.4
    """

    keys = ("dim",)
    folds = {"g": "sum", "mistakes": "sum", "total": "sum"}

    def __init__(self, rows: DataFrame, kind: str = "perceptron", max_rounds: int = 15, least_error: float = 1e-4):
        self.rows, self.kind, self.max_rounds, self.least_error = rows, kind, max_rounds, least_error
        self.sparse = "ids" in rows.columns

    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        return self.rows

    def map(self, rows: DataFrame, model: LinearModel, context: Context) -> DataFrame:
        names = ["split", "y", *(["ids", "vals"] if self.sparse else ["x"])]
        rows = rows if "split" in rows.columns else rows.withColumn("split", F.lit(0))
        shared = rows.sparkSession.sparkContext.broadcast(np.asarray(model.weights, float))
        return rows.select(F.col("split").cast("long").alias("split"), F.col("y").cast("double").alias("y"), *names[2:]).mapInArrow(_gradient(shared, self.kind), "split long, dim int, g double, mistakes long, total long")

    def update(self, results: list[Row], model: LinearModel, context: Context) -> LinearModel:
        g = {r["dim"]: r["g"] for r in results}
        n = sum(r["total"] for r in results)
        wrong = sum(r["mistakes"] for r in results)
        step = 100 * 0.9**context.round if self.kind in ("decay", "threshold") else model.step
        scale = 1.0 if self.kind == "logistic" else step / max(n, 1)
        weights = [w + scale * g.get(i, 0.0) for i, w in enumerate(model.weights)]
        error = 100.0 * wrong / max(n, 1)
        return LinearModel(weights, model.step * (0.9 if self.kind == "perceptron" else 1.0), error, [*model.history, error], n - wrong, n)

    def should_terminate(self, model: LinearModel, context: Context) -> bool:
        return context.round >= self.max_rounds or model.error < self.least_error


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of every entry of a batch; nulls are no entries."""
    lists = batch.column("x" if "x" in batch.schema.names else "vals")
    sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    dim = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if "x" in batch.schema.names else batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    real = ~np.isnan(value)
    return row[real], dim[real], value[real]


def _factor(kind: str, y: np.ndarray, ip: np.ndarray) -> np.ndarray:
    """What each row's x is multiplied with in the gradient."""
    if kind == "perceptron":
        return np.where((ip > 0) != (y > 0), y, 0.0)
    with np.errstate(over="ignore"):
        if kind == "logistic":
            return -(1 / (1 + np.exp(-y * ip)) - 1) * y
        e = np.where(y > 0, 1.0, 0.0) - 1 / (1 + np.exp(-ip))
    return np.where(np.abs(e) > 0.4, e, 0.0) if kind == "threshold" else e


def _gradient(shared, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, parts = shared.value, {}
        for batch in batches:
            row, dim, value = _entries(batch)
            y, split = batch.column("y").to_numpy(zero_copy_only=False), batch.column("split").to_numpy(zero_copy_only=False)
            ip = np.bincount(row, value * w[dim], batch.num_rows)
            wrong, factor = (ip > 0) != (y > 0), _factor(kind, y, ip)
            for s in np.unique(split).tolist():
                g, met, counts = parts.setdefault(s, (np.zeros(len(w)), np.zeros(len(w), bool), np.zeros(2, np.int64)))
                mine = split[row] == s
                np.add.at(g, dim[mine], value[mine] * factor[row[mine]])
                met[dim[mine]] = True
                counts += (int(wrong[split == s].sum()), int((split == s).sum()))
        for s, (g, met, counts) in parts.items():
            dims = np.flatnonzero(met)
            for k in range(0, len(dims) + 1, 1 << 16):  # the counters go with dimension -1
                at = np.concatenate([[-1], dims[: 1 << 16]]) if k == 0 else dims[k : k + (1 << 16)]
                first = at < 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), s, np.int64), at.astype(np.int32), np.where(first, 0.0, g[at]), np.where(first, counts[0], 0), np.where(first, counts[1], 0))], names=["split", "dim", "g", "mistakes", "total"])

    return run


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, dim, value = _entries(batch)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.bincount(row, value * shared.value[dim], batch.num_rows).astype(float))], names=["y", "ip"])

    return run


def accuracy(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Share of rows (y, x) or (y, ids, vals) whose product with the weights has the sign of y; a product of zero is negative."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(weights, float))
    scored = rows.select(F.col("y").cast("double").alias("y"), *(["ids", "vals"] if "ids" in rows.columns else ["x"])).mapInArrow(_score(shared), "y double, ip double")
    right = (F.col("ip") > 0) == (F.col("y") > 0)
    return scored.agg(F.count("*").alias("total"), F.sum(right.cast("long")).alias("correct"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def gzip_ratio(values: list[float]) -> float:
    """Compressed size of a gradient's 64-bit floats over their size."""
    raw = np.asarray(values, "<f8").tobytes()
    return len(gzip.compress(raw, mtime=0)) / max(1, len(raw))
