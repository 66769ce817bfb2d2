"""k-means: dense points and vectors, seeding, restarts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import nearest, point
from ..plans.options import Options
from ..sources.scans import from_histogram, from_options
from ..sources.sinks import checkpointed
from .iterate import Context, IterativeJob, run


@dataclass
class KMeansModel:
    centroids: list[tuple[float, ...]]
    counts: list[int] = field(default_factory=list)
    changed: bool = True
    distance_sum: float = 0.0
    examples: int = 0  # over all rounds


class KMeansJob(IterativeJob):
    """Lloyd's rounds over points given as columns.

    A point goes to the strictly nearest centroid, of equal ones to the first. distance_sum adds
    Euclidean distances to the centroids before the update. A cluster without points becomes the
    origin (empty="zero") or stays (empty="keep"). one_move: centroids are updated in order up to the
    first that moves. Rows with a null coordinate are left out. Without points, lines `x y` are read
    from the paths of the options.
    """

    keys = ("cid",)

    def __init__(self, points: DataFrame | None = None, columns: Sequence[str] = ("x", "y"), max_rounds: int = 20, empty: str = "zero", one_move: bool = False, tolerance: float = 1e-10):
        self.points, self.columns, self.max_rounds, self.empty, self.one_move, self.tolerance = points, list(columns), max_rounds, empty, one_move, tolerance
        self.folds = {"n": "sum", "distance": "sum", **{f"s{i}": "sum" for i in range(len(self.columns))}}

    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        points = self.points
        if points is None:
            points = from_options(spark, options).select("split", point(F.col("value")).alias("p")).select("split", "p.*")
        keep = [F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(self.columns)]
        return points.select(*keep, *(["split"] if "split" in points.columns else [])).dropna(subset=[f"s{i}" for i in range(len(keep))])

    def map(self, rows: DataFrame, model: KMeansModel, context: Context) -> DataFrame:
        distances = [self._distance(c) for c in model.centroids]
        return rows.withColumns({"cid": nearest(distances), "distance": F.least(*distances) if len(distances) > 1 else distances[0], "n": F.lit(1)})

    def _distance(self, centroid: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for i, x in enumerate(centroid):
            d = F.col(f"s{i}") - F.lit(float(x))
            total = total + d * d
        return F.sqrt(total)

    def update(self, results: list[Row], model: KMeansModel, context: Context) -> KMeansModel:
        by = {r["cid"]: r for r in results}
        out, counts, changed = [], [], False
        for cid, old in enumerate(model.centroids):
            r = by.get(cid)
            counts.append(r["n"] if r else 0)
            new = tuple(r[f"s{i}"] / r["n"] for i in range(len(old))) if r else old if self.empty == "keep" else (0.0,) * len(old)
            if self.one_move and changed:
                new = old
            changed |= any(abs(a - b) > self.tolerance for a, b in zip(new, old, strict=True))
            out.append(new)
        n = sum(counts)
        return KMeansModel(out, counts, changed, sum(r["distance"] for r in results), model.examples + n)

    def should_terminate(self, model: KMeansModel, context: Context) -> bool:
        return context.round >= self.max_rounds or not model.changed


def seeds(points: DataFrame, columns: Sequence[str], id_col: str, k: int, seed: int) -> list[tuple[float, ...]]:
    """k points, each row as likely as any other: a reservoir of the k rows with the smallest hash of id and seed in each task, merged in the end. Fewer than k points are an error."""
    order = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = points.dropna(subset=list(columns)).select(order.alias("o"), *[F.col(c).cast("double").alias(c) for c in columns]).orderBy("o", *columns).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} seeds asked for, {len(rows)} points there")
    return [tuple(r[c] for c in columns) for r in rows]


def best_of(spark: SparkSession, points: DataFrame, columns: Sequence[str], id_col: str, k: int = 3, trials: int = 3, max_rounds: int = 20, options: Options | None = None) -> tuple[int, KMeansModel]:
    """The trial with the smallest distance_sum, and its number."""
    found = []
    for t in range(trials):
        model, _ = run(spark, KMeansJob(points, columns, max_rounds), KMeansModel(seeds(points, columns, id_col, k, t)), options)
        found.append((model.distance_sum, t, model))
    _, t, model = min(found, key=lambda x: x[:2])
    return t, model


@dataclass
class SparseModel:
    """centroids: rows (cid, dim, val); a cluster without rows is the origin."""

    centroids: DataFrame
    k: int
    distance_sum: float = 0.0
    total_examples: int = 0  # over all rounds


def sparse_assign(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(id, cid, distance) of the nearest of k clusters for points (id, dim, val), of equal ones the first.

    |c - x|^2 = |c|^2 + |x|^2 - 2 c.x: points meet centroids only in the dimensions that both have, so
    nothing depends on how many dimensions there are. The k norms stand in the plan.
    """
    norm = dict.fromkeys(range(k), 0.0) | {r["cid"]: r["norm"] for r in centroids.groupBy("cid").agg(F.sum(F.col("val") * F.col("val")).alias("norm")).collect()}
    model = centroids.select("cid", "dim", F.col("val").alias("c"))
    shared = points.join(model, "dim", "left").groupBy("id", "cid").agg(F.sum(F.col("c") * F.col("val")).alias("dot"))
    square = points.groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("square"))
    dots = shared.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("cid").isNotNull(), F.struct("cid", "dot")))).alias("dots"))
    each = [F.struct((F.lit(float(norm[c])) - 2 * F.coalesce(F.col("dots")[F.lit(c)], F.lit(0.0))).alias("d"), F.lit(c).alias("cid")) for c in range(k)]
    best = dots.select("id", F.array_min(F.array(*each)).alias("b"))
    return best.join(square, "id").select("id", F.col("b.cid").alias("cid"), F.sqrt(F.greatest(F.col("b.d") + F.col("square"), F.lit(0.0))).alias("distance"))


def sparse_kmeans(points: DataFrame, model: SparseModel, rounds: int) -> SparseModel:
    """So many rounds over points (id, dim, val); rounds don't stop early. A cluster without points becomes the origin.

    The model stays a table; each round's is checkpointed. points are cached.
    """
    points = points.select("id", "dim", F.col("val").cast("double").alias("val")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            best = checkpointed(sparse_assign(points, model.centroids, model.k))
            sizes = best.groupBy("cid").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"))
            sums = points.join(best.select("id", "cid"), "id").groupBy("cid", "dim").agg(F.sum("val").alias("total"))
            moved = checkpointed(sums.join(sizes, "cid").select("cid", "dim", (F.col("total") / F.col("n")).alias("val")))
            whole = sizes.agg(F.sum("n").alias("n"), F.sum("distance").alias("distance")).first()
            model = SparseModel(moved, model.k, whole["distance"] or 0.0, model.total_examples + (whole["n"] or 0))
        return model
    finally:
        points.unpersist()


def sparse_start(spark: SparkSession, k: int, dims: int, values: Sequence[tuple[int, float]] | None = None, low: float = 0.0, high: float = 1.0, seed: int = 1000) -> SparseModel:
    """k centroids with all dimensions, drawn from a histogram of values or evenly from low to high; the same for the same seed."""
    rows = spark.range(k * dims).select((F.col("id") % k).cast("int").alias("cid"), F.floor(F.col("id") / k).cast("int").alias("dim"))
    draw = F.pmod(F.xxhash64("cid", "dim", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    value = from_histogram(draw, values).cast("double") if values else low + draw * (high - low)
    return SparseModel(rows.withColumn("val", value), k)
