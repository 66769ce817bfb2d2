"""Every query of the iterative engine over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import kmeans as K
from .operators import linear as L
from .operators import metrics as M
from .operators import relational as R
from .operators import train_merge as T
from .operators.frames import Info, ObjectJob, run_frames
from .operators.iterate import Context, RecoveryAction, reduce_generic, reduce_tree, run
from .plans.options import Options
from .plans.shapes import heap_depths, heap_parents, nary_levels, spread_steps
from .sources import scans as S
from .sources import sinks as W
from .streaming import windows as SW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


START = [(50.0, 20.0), (200.0, 80.0), (400.0, 120.0)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") / 10).alias("y"))


def _model_frame(spark: SparkSession, model: K.KMeansModel) -> DataFrame:
    rows = [(i, n, *map(float, c)) for i, (c, n) in enumerate(zip(model.centroids, model.counts, strict=True))]
    df = spark.createDataFrame(rows, "cid int, n long, x double, y double")
    return df.select("cid", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.lit(round(model.distance_sum, 2)).alias("distance_sum"))


def _kmeans_sql(start: str, rounds: int, prefix: str = "") -> str:
    steps = [f"{prefix}c0 AS ({start})"]
    for k in range(rounds):
        steps.append(f"{prefix}a{k} AS MATERIALIZED (SELECT id, px, py, cid, d FROM (SELECT id, p.x AS px, p.y AS py, cid, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM p, {prefix}c{k} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)")
        steps.append(f"{prefix}c{k + 1} AS MATERIALIZED (SELECT c.cid, coalesce(avg(px), 0) AS x, coalesce(avg(py), 0) AS y, count(px) AS n FROM {prefix}c{k} c LEFT JOIN {prefix}a{k} a ON a.cid = c.cid GROUP BY c.cid)")
    return ", ".join(steps)


ROUNDS = 5
_P = "p AS MATERIALIZED (SELECT o_orderkey AS id, o_totalprice / 1000 AS x, o_custkey / 10 AS y FROM orders)"
_START = "SELECT * FROM (VALUES (0, 50.0::DOUBLE, 20.0::DOUBLE), (1, 200.0::DOUBLE, 80.0::DOUBLE), (2, 400.0::DOUBLE, 120.0::DOUBLE)) t(cid, x, y)"


def _kmeans_result(last: int) -> str:
    return f"SELECT cid::INT AS cid, n, round(x, 4) AS x, round(y, 4) AS y, (SELECT round(sum(d), 2) FROM a{last - 1}) AS distance_sum FROM c{last}"


@_query(f"WITH {_P}, {_kmeans_sql(_START, ROUNDS)} {_kmeans_result(ROUNDS)}")
def kmeans_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = run(spark, K.KMeansJob(_points(spark, sf_dir), ["x", "y"], ROUNDS, tolerance=-1), K.KMeansModel(list(START)), Options(cache="memory"))
    return _model_frame(spark, model)


def _shaped(name: str, options: Options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir).withColumn("split", F.col("o_orderkey") % 8)
        model, _ = run(spark, K.KMeansJob(points, ["x", "y"], 2, tolerance=-1), K.KMeansModel(list(START)), options)
        return _model_frame(spark, model)

    query.__name__ = name
    _query(f"WITH {_P}, {_kmeans_sql(_START, 2)} {_kmeans_result(2)}")(query)


_shaped("kmeans_flat_aggregation", Options(cache="none", aggregation="none"))
_shaped("kmeans_generic_aggregation", Options(cache="disk", aggregation="generic", agg_count=3))
_shaped("kmeans_nary_aggregation", Options(cache="memory", aggregation="nary", fan_in=2))


class _Failing(K.KMeansJob):
    """Rows of splits 1 and 3 raise an error in the first try of every round."""

    def __init__(self, *args, action: RecoveryAction, **more):
        super().__init__(*args, **more)
        self.action = action

    def map(self, rows: DataFrame, model: K.KMeansModel, context: Context) -> DataFrame:
        fault = F.raise_error(F.concat(F.lit("injected in split "), F.col("split").cast("string"))).cast("int")
        bad = (F.col("split").isin(1, 3)) & F.lit(context.attempt == 0)
        return super().map(rows, model, context).withColumn("n", F.when(bad, fault).otherwise(F.col("n")))

    def on_failed(self, completed: set[int], context: Context) -> RecoveryAction:
        return self.action


def _recovering(name: str, action: RecoveryAction, where: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _points(spark, sf_dir).withColumn("split", F.col("o_orderkey") % 8)
        model, _ = run(spark, _Failing(points, ["x", "y"], 2, tolerance=-1, action=action), K.KMeansModel(list(START)), Options(cache="memory"))
        return _model_frame(spark, model)

    query.__name__ = name
    p = _P.replace("FROM orders", f"FROM orders {where}")
    _query(f"WITH {p}, {_kmeans_sql(_START, 2)} {_kmeans_result(2)}")(query)


_recovering("recover_accept", RecoveryAction.ACCEPT, "WHERE o_orderkey % 8 NOT IN (1, 3)")
_recovering("recover_rerun", RecoveryAction.RERUN, "")
_recovering("recover_partially_rerun", RecoveryAction.PARTIALLY_RERUN, "")

_SEEDS = "SELECT row_number() OVER (ORDER BY md5(id::VARCHAR || ':{t}'), x, y) - 1 AS cid, x, y FROM p QUALIFY cid < {k}"


@_query(f"WITH {_P} " + " UNION ALL ".join(f"SELECT {t} AS trial, cid::INT AS cid, round(x, 4) AS x, round(y, 4) AS y FROM ({_SEEDS.format(t=t, k=3)})" for t in range(3)))
def reservoir_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    rows = [(t, i, *p) for t in range(3) for i, p in enumerate(K.seeds(points, ["x", "y"], "o_orderkey", 3, t))]
    return spark.createDataFrame(rows, "trial int, cid int, x double, y double").select("trial", "cid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_query(
    f"WITH {_P}, "
    + ", ".join(_kmeans_sql(_SEEDS.format(t=t, k=3), 3, f"t{t}") for t in range(3))
    + ", b AS (SELECT trial FROM ("
    + " UNION ALL ".join(f"SELECT {t} AS trial, sum(d) AS s FROM t{t}a2" for t in range(3))
    + ") ORDER BY s, trial LIMIT 1) "
    + " UNION ALL ".join(f"SELECT {t} AS trial, cid::INT AS cid, n, round(x, 4) AS x, round(y, 4) AS y FROM t{t}c3 WHERE (SELECT trial FROM b) = {t}" for t in range(3))
)
def kmeans_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).persist()
    try:
        trial, model = K.best_of(spark, points, ["x", "y"], "o_orderkey", 3, 3, 3)
    finally:
        points.unpersist()
    return _model_frame(spark, model).select(F.lit(trial).alias("trial"), "cid", "n", "x", "y")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") > 4, 1.0).otherwise(-1.0).alias("y"), F.col("embedding").alias("x"))


_E = "e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"
DIMS = 64


def _linear_sql(kind: str, rounds: int, result: str = "") -> str:
    steps = [_E, f"w0 AS (SELECT unnest(range(0, {DIMS}))::INT AS dim, 0.0::DOUBLE AS w)"]
    for k in range(rounds):
        steps.append(f"i{k} AS MATERIALIZED (SELECT id, any_value(y) AS y, sum(v * w) AS ip FROM e JOIN w{k} USING (dim) GROUP BY id)")
        p = "1.0 / (1.0 + exp(-ip))"
        factor = {"perceptron": "CASE WHEN (ip > 0) <> (y > 0) THEN y ELSE 0 END", "logistic": "-(1.0 / (1.0 + exp(-(y * ip))) - 1.0) * y", "decay": f"(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END - {p})", "threshold": f"CASE WHEN abs(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END - {p}) > 0.4 THEN CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END - {p} ELSE 0 END"}[kind]
        scale = {"perceptron": f"{0.9**k} / (SELECT count(*) FROM i{k})", "logistic": "1.0", "decay": f"{100 * 0.9**k} / (SELECT count(*) FROM i{k})", "threshold": f"{100 * 0.9**k} / (SELECT count(*) FROM i{k})"}[kind]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.dim, w.w + {scale} * g.g AS w FROM w{k} w JOIN (SELECT dim, sum(v * ({factor})) AS g FROM (SELECT id, dim, v FROM e) JOIN i{k} USING (id) GROUP BY dim) g USING (dim))")
    if result:
        return "WITH " + ", ".join([*steps, result])
    return "WITH " + ", ".join(steps) + f" SELECT dim, round(w, 5) AS w, (SELECT round(100.0 * sum(((ip > 0) <> (y > 0))::INT) / count(*), 5) FROM i{rounds - 1}) AS error FROM w{rounds}"


def _linear(name: str, kind: str, rounds: int = 4) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        job = L.LinearJob(_vectors(spark, sf_dir), kind, rounds, -1.0)
        model, _ = run(spark, job, L.LinearModel([0.0] * DIMS), Options(cache="memory"))
        return spark.createDataFrame([(i, round(w, 5), round(model.error, 5)) for i, w in enumerate(model.weights)], "dim int, w double, error double")

    query.__name__ = name
    _query(_linear_sql(kind, rounds))(query)


_linear("perceptron_embeddings", "perceptron", 6)
_linear("logistic_embeddings", "logistic")
_linear("logistic_decaying_step", "decay")
_linear("logistic_thresholded", "threshold")


@_query(_linear_sql("logistic", 3).replace("SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings", "SELECT * FROM (SELECT vec_id AS id, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) WHERE (id + dim) % 3 = 0"))
def logistic_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse rows among a million dimensions: every third entry of the vectors."""
    at = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("dim"), v.alias("v"))), lambda e: (F.col("id") + e["dim"]) % 3 == 0)
    rows = _vectors(spark, sf_dir).select("id", "y", at.alias("e")).select("y", F.col("e.dim").alias("ids"), F.col("e.v").alias("vals"))
    model, _ = run(spark, L.LinearJob(rows, "logistic", 3, -1.0), L.LinearModel([0.0] * 1_000_000), Options(cache="memory"))
    return spark.createDataFrame([(i, round(w, 5), round(model.error, 5)) for i, w in enumerate(model.weights[:DIMS])], "dim int, w double, error double")


@_query(_linear_sql("perceptron", 6, "r AS (SELECT id, any_value(y) AS y, sum(v * w) AS ip FROM e JOIN w6 USING (dim) GROUP BY id) SELECT count(*) AS total, sum(((ip > 0) = (y > 0))::INT)::BIGINT AS correct, round(avg(((ip > 0) = (y > 0))::INT), 6) AS accuracy FROM r"))
def linear_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    model, _ = run(spark, L.LinearJob(rows, "perceptron", 6, -1.0), L.LinearModel([0.0] * DIMS), Options(cache="memory"))
    return L.accuracy(rows, model.weights)


def _sparse_sql(rounds: int, k: int = 3) -> str:
    steps = [_E, f"c0 AS (SELECT id AS cid, dim, v FROM e WHERE id < {k})"]
    for r in range(rounds):
        steps.append(f"d{r} AS (SELECT e.id, c.cid, sqrt(sum((e.v - c.v) * (e.v - c.v))) AS d FROM e JOIN c{r} c USING (dim) GROUP BY ALL)")
        steps.append(f"b{r} AS MATERIALIZED (SELECT id, cid, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cid, dim, avg(v) AS v FROM e JOIN b{r} USING (id) GROUP BY ALL)")
    return "WITH " + ", ".join(steps) + f" SELECT cid::INT AS cid, dim, round(v, 5) AS val, (SELECT round(sum(d), 3) FROM b{rounds - 1}) AS distance, (SELECT count(*) * {rounds} FROM embeddings) AS examples FROM c{rounds}"


def _sparse(name: str, rounds: int) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "val"))
        start = K.SparseModel(points.where("id < 3").select(F.col("id").cast("int").alias("cid"), "dim", F.col("val").cast("double").alias("val")), 3)
        model = K.sparse_kmeans(points, start, rounds)
        return model.centroids.select("cid", "dim", F.round("val", 5).alias("val"), F.lit(round(model.distance_sum, 3)).alias("distance"), F.lit(model.total_examples).cast("long").alias("examples"))

    query.__name__ = name
    _query(_sparse_sql(rounds))(query)


_sparse("sparse_kmeans_round", 1)
_sparse("sparse_kmeans_3rounds", 3)


@_query("SELECT pos::INT AS pos, round(sum(v), 4) AS total FROM (SELECT unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY pos")
def vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_sum(_table(spark, sf_dir, "embeddings"), "embedding").select("pos", F.round("total", 4).alias("total"))


@_query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\r\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.word_count(_table(spark, sf_dir, "documents").select(S.white_tokens(F.col("text")).alias("tokens")))


@_query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9_]', ' ', 'g')), '[ \t\r\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.word_count(_table(spark, sf_dir, "documents").select(S.lower_tokens(F.col("text")).alias("tokens")))


@_query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\x0B\f\r.,!@#$%^&*()+=:;"''{}\[\]|\\/<>?~`]+')) AS word FROM conversations) WHERE word <> '' GROUP BY word""")
def word_count_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.word_count(_table(spark, sf_dir, "conversations").select(S.word_tokens(F.col("text")).alias("tokens")))


def _counted(name: str, method: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.group_count(_table(spark, sf_dir, "lineitem"), "l_suppkey", method)

    query.__name__ = name
    _query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")(query)


_counted("group_count_hash", "hash")
_counted("group_count_external", "external")
_counted("group_count_sorted", "sort")


@_query("SELECT count(*) AS n FROM documents WHERE contains(text, 'th')")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(F.col("text").contains("th")).agg(F.count("*").alias("n"))


@_query("SELECT conv_id, string_agg(role || ':' || len(text), '' ORDER BY turn) AS joined, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.length("text")).alias("t"))
    return R.ordered_concat(rows, ["conv_id"], ["turn"], "t")


class _Hello(ObjectJob):
    """Each split's words joined; every reduction puts what it gets into brackets; the update appends."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        return self.rows

    def map(self, rows, model, info: Info) -> str:
        return "+".join(r["word"] for r in rows)

    def reduce(self, results, info: Info) -> str:
        return "(" + ",".join(results) + f")_{info.node}"

    def update(self, results, model, info: Info) -> str:
        return model + ";".join(results)

    def should_terminate(self, model, info: Info) -> bool:
        return info.round >= 1


@_query("WITH a AS (SELECT r_regionkey AS k, r_name AS t FROM region), b AS (SELECT k // 2 AS k, '(' || string_agg(t, ',' ORDER BY k) || ')_' || (k // 2) AS t FROM a GROUP BY k // 2), c AS (SELECT k // 2 AS k, '(' || string_agg(t, ',' ORDER BY k) || ')_' || (k // 2) AS t FROM b GROUP BY k // 2), d AS (SELECT '(' || string_agg(t, ',' ORDER BY k) || ')_0' AS t FROM c) SELECT 'model:' || t AS trace FROM d")
def hello_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for each region, reduced along a binary tree."""
    rows = _table(spark, sf_dir, "region").select(F.col("r_name").alias("word"), "r_regionkey").repartitionById(5, F.col("r_regionkey").cast("int"))
    model, _ = run_frames(spark, _Hello(rows.select("word")), "model:", Options(aggregation="nary", fan_in=2))
    return spark.createDataFrame([(model,)], "trace string")


class _Totals(ObjectJob):
    """Sum, count, smallest and largest of a column by a key: a reduction of dicts."""

    def __init__(self, rows: DataFrame, action: RecoveryAction | None = None):
        self.rows, self.action = rows, action

    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        return self.rows

    def map(self, rows, model, info: Info) -> dict:
        if self.action and info.rerun == 0 and info.node in (1, 3):
            raise ValueError("injected")
        return self.reduce(({r["k"]: (r["v"], 1, r["v"], r["v"])} for r in rows), info)

    def reduce(self, results, info: Info) -> dict:
        out: dict = {}
        for part in results:
            for k, (s, n, low, high) in part.items():
                a = out.get(k)
                out[k] = (a[0] + s, a[1] + n, min(a[2], low), max(a[3], high)) if a else (s, n, low, high)
        return out

    def update(self, results, model, info: Info) -> dict:
        return self.reduce(results, info)

    def on_failed(self, completed, failed, info: Info) -> RecoveryAction:
        return self.action or RecoveryAction.RERUN


def _frames(name: str, options: Options, action: RecoveryAction | None = None, where: str = "") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("double").alias("v"), F.pmod("l_orderkey", F.lit(8)).cast("int").alias("s"))
        model, _ = run_frames(spark, _Totals(rows.repartitionById(8, F.col("s")).select("k", "v"), action), {}, options)
        return spark.createDataFrame([(k, round(s, 2), n, low, high) for k, (s, n, low, high) in model.items()], "l_returnflag string, total double, n long, low double, high double")

    query.__name__ = name
    _query(f"SELECT l_returnflag, round(sum(l_quantity), 2)::DOUBLE AS total, count(*) AS n, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high FROM lineitem {where} GROUP BY l_returnflag")(query)


_frames("reduce_none", Options(aggregation="none"))
_frames("reduce_generic", Options(aggregation="generic", agg_count=3))
_frames("reduce_nary_f2", Options(aggregation="nary", fan_in=2))
_frames("reduce_nary_f3", Options(aggregation="nary", fan_in=3, compress_after=0))
_frames("reduce_heap", Options(aggregation="nary", fan_in=2, native={"dynamic": True}))
_frames("frames_accept", Options(), RecoveryAction.ACCEPT, "WHERE l_orderkey % 8 NOT IN (1, 3)")
_frames("frames_rerun", Options(), RecoveryAction.RERUN)
_frames("frames_partially_rerun", Options(aggregation="nary"), RecoveryAction.PARTIALLY_RERUN)


@_query("SELECT 0 AS round, 'map' AS operator, 8 AS tasks, count(*) AS records FROM lineitem UNION ALL SELECT 0, 'reduce', 7, 14")
def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and records of each operator: eight splits folded along a binary tree of 4, 2 and 1 nodes."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("double").alias("v"), F.pmod("l_orderkey", F.lit(8)).cast("int").alias("s"))
    _, reports = run_frames(spark, _Totals(rows.repartitionById(8, F.col("s")).select("k", "v")), {}, Options(aggregation="nary", fan_in=2))
    return M.rollup(M.metrics(spark, reports)).select("round", "operator", F.col("tasks").cast("int").alias("tasks"), "records")


@_query("SELECT (l_orderkey % 3)::INT AS round, (l_suppkey % 50)::INT AS split, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def split_dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).cast("int").alias("round"), (F.col("l_suppkey") % 50).cast("int").alias("node"))
    return M.duplicate_splits(rows)


_TREE = "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_returnflag"
_FOLDS = {"n": "sum", "quantity": "sum", "first_ship": "min", "top_price": "max"}


def _partials(spark: SparkSession, sf_dir: str, splits: int) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("split", F.col("l_orderkey") % splits)
    return rows.groupBy("split", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_shipdate").alias("first_ship"), F.max("l_extendedprice").alias("top_price"))


@_query(_TREE)
def aggregate_nary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_tree(_partials(spark, sf_dir, 16), ["l_returnflag"], _FOLDS, 16, 3).withColumn("quantity", F.round("quantity", 2))


@_query(_TREE)
def aggregate_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_generic(_partials(spark, sf_dir, 16), ["l_returnflag"], _FOLDS, 16, 4).withColumn("quantity", F.round("quantity", 2))


@_query("WITH l AS (SELECT l_orderkey % 15 AS node, sum(l_quantity)::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1), " + ", ".join(f"l{d} AS (SELECT CASE WHEN node >= {2**d - 1} THEN (node - 1) // 2 ELSE node END AS node, sum(v) AS v, sum(n) AS n FROM {'l' if d == 3 else f'l{d + 1}'} GROUP BY 1)" for d in (3, 2, 1)) + " SELECT 3 - d AS step, node::INT AS node, round(v, 2) AS total, n::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT {d} AS d, * FROM l{d}" for d in (3, 2, 1)) + ")")
def heap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen splits folded along a binary heap: after each step the nodes that are left, with their sums."""
    depths, out = heap_depths(15, 2), None
    parents = F.array(*map(F.lit, heap_parents(15, 2)))
    left = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 15).cast("int").alias("node")).agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))
    for depth in range(max(depths), 0, -1):
        up = F.when(F.col("node").isin([i for i, d in enumerate(depths) if d == depth]), F.get(parents, F.col("node"))).otherwise(F.col("node"))
        left = left.groupBy(up.alias("node")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        step = left.select(F.lit(max(depths) - depth).alias("step"), "node", F.round(F.col("total").cast("double"), 2).alias("total"), "n")
        out = step if out is None else out.unionByName(step)
    return out


@_query("SELECT n_nationkey + 1 AS nodes, ceil(log2(n_nationkey + 1))::INT AS steps FROM nation")
def spread_steps_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in which a model reaches so many nodes."""
    rows = [(r.n_nationkey + 1, spread_steps(r.n_nationkey + 1)) for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame(rows, "nodes long, steps int").select(F.col("nodes").cast(_table(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("nodes"), "steps")


@_query("WITH RECURSIVE t AS (SELECT n_nationkey + 1 AS leaves, 1 AS level, greatest(1, ceil((n_nationkey + 1) / 3.0))::INT AS nodes FROM nation UNION ALL SELECT leaves, level + 1, ceil(nodes / 3.0)::INT FROM t WHERE nodes > 1) SELECT leaves::BIGINT AS leaves, level::INT AS level, nodes::INT AS nodes FROM t")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on each level of a tree of fan-in three over so many leaves."""
    leaves = [r.n_nationkey + 1 for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(n, k, m) for n in leaves for k, m in enumerate(nary_levels(n, 3), 1)], "leaves long, level int, nodes int")


@_query("SELECT ascii(substr(word, 1, 1)) % 4 AS bucket, count(*) AS words, count(DISTINCT word) AS distinct_words FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1".replace("\\\\", "\\"))
def hash_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "conversations").select(F.explode(S.white_tokens(F.col("text"))).alias("word"))
    return R.with_bucket(words, F.ascii(F.substring("word", 1, 1)), 4).groupBy("bucket").agg(F.count("*").alias("words"), F.countDistinct("word").alias("distinct_words"))


@_query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS total, count(c_acctbal) AS n, arg_min(c_custkey, (c_acctbal, c_custkey)) AS arg_min, arg_max(c_acctbal, c_custkey) AS last_value FROM customer GROUP BY c_nationkey")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summaries(_table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").withColumn("total", F.round("total", 2))


@_query(f"WITH {_P}, {_kmeans_sql(_START, 1)} SELECT id AS o_orderkey, cid::INT AS cid, round(d, 6) AS distance FROM a0")
def cross_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with the whole model: its nearest centroid."""
    job = K.KMeansJob(_points(spark, sf_dir), ["x", "y"])
    points = _points(spark, sf_dir).select("o_orderkey", F.col("x").alias("s0"), F.col("y").alias("s1"))
    return job.map(points, K.KMeansModel(list(START)), Context()).select("o_orderkey", "cid", F.round("distance", 6).alias("distance"))


@_query("SELECT split, round, records FROM (SELECT l_orderkey % 8 AS split, count(*) AS records FROM lineitem GROUP BY 1), (VALUES (0), (1)) t(round)")
def round_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split in each round, as the loop reports them."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), (F.col("l_orderkey") % 8).alias("split"))
    _, reports = run(spark, K.KMeansJob(rows, ["x", "y"], 2, tolerance=-1), K.KMeansModel([(1.0, 0.0), (40.0, 0.0)]), Options(cache="memory"))
    return spark.createDataFrame([(s, r.round, n) for r in reports for s, n in r.records.items()], "split long, round int, records long")


@_query("SELECT l_returnflag, sum(l_quantity)::BIGINT AS quantity, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag")
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table written as files with bars between columns and read again with a declared schema."""
    path = W.scratch(spark, "delimited")
    W.write_delimited(_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long"), "l_returnflag"), path)
    rows = S.delimited(spark, path, "l_orderkey long, quantity long, l_returnflag string")
    return rows.groupBy("l_returnflag").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@_query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\r\n]+')) AS word FROM conversations) WHERE word <> '' GROUP BY word")
def text_scan_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines, read back in four splits of one path, their words counted."""
    path = W.scratch(spark, "lines")
    lines = _table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.coalesce(1).write.text(path)
    return R.word_count(S.text_lines(spark, path, num_splits=4).select(S.white_tokens(F.col("value")).alias("tokens")))


@_query("SELECT 6 AS files, count(*) AS n, count(DISTINCT o_orderkey) AS orders, sum(o_orderkey)::BIGINT AS keys FROM orders")
def rebalance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt out to six gzip files and read back: none is lost."""
    path = W.scratch(spark, "rebalanced")
    W.rebalance(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")), path, 6, "gzip")
    rows = S.text_lines(spark, path)
    return rows.agg(F.countDistinct("split").cast("int").alias("files"), F.count("*").alias("n"), F.countDistinct("value").alias("orders"), F.sum(F.col("value").cast("long")).alias("keys"))


_CLUSTERS = "SELECT * FROM (VALUES (0, 50.0::DOUBLE, 20.0::DOUBLE), (1, -9000.0::DOUBLE, -9000.0::DOUBLE), (2, 400.0::DOUBLE, 120.0::DOUBLE)) t(cid, x, y)"


@_query(f"WITH {_P}, {_kmeans_sql(_CLUSTERS, 1)} {_kmeans_result(1)}")
def kmeans_empty_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centroid too far away for any point moves to the origin."""
    start = K.KMeansModel([(50.0, 20.0), (-9000.0, -9000.0), (400.0, 120.0)])
    model, _ = run(spark, K.KMeansJob(_points(spark, sf_dir), ["x", "y"], 1, tolerance=-1), start, Options(cache="memory"))
    return _model_frame(spark, model)


def _one_move_sql(rounds: int) -> str:
    steps = [f"c0 AS ({_START})"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED (SELECT id, px, py, cid, d FROM (SELECT id, p.x AS px, p.y AS py, cid, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM p, c{k} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1)")
        steps.append(f"m{k} AS MATERIALIZED (SELECT c.cid, c.x AS ox, c.y AS oy, coalesce(avg(px), 0) AS x, coalesce(avg(py), 0) AS y, count(px) AS n FROM c{k} c LEFT JOIN a{k} a ON a.cid = c.cid GROUP BY ALL)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cid, CASE WHEN cid <= f THEN x ELSE ox END AS x, CASE WHEN cid <= f THEN y ELSE oy END AS y, n FROM m{k}, (SELECT coalesce(min(cid), 99) AS f FROM m{k} WHERE abs(x - ox) > 1e-10 OR abs(y - oy) > 1e-10))")
    return ", ".join(steps)


@_query(f"WITH {_P}, {_one_move_sql(4)} {_kmeans_result(4)}")
def kmeans_one_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds in each of which only the first centroid that changes moves."""
    model, _ = run(spark, K.KMeansJob(_points(spark, sf_dir), ["x", "y"], 4, one_move=True), K.KMeansModel(list(START)), Options(cache="memory"))
    return _model_frame(spark, model)


@_query(f"WITH {_P}, {_kmeans_sql(_START, 2)} {_kmeans_result(2)}")
def kmeans_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as lines and read as the options' paths and sizes say."""
    path = W.scratch(spark, "points")
    _points(spark, sf_dir).select(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.text(path)
    options = Options(paths=[path], cache="memory", aggregation="nary", fan_in=2, min_split_size=1, max_split_size=200_000)
    model, _ = run(spark, K.KMeansJob(max_rounds=2, tolerance=-1), K.KMeansModel(list(START)), options)
    return _model_frame(spark, model)


@_query("SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS invalid, sum(c_custkey % 7)::BIGINT AS labels, round(sum(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey + 0.5 END), 2)::DOUBLE AS total FROM customer")
def sparse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `label id:value`, of which every tenth is broken, parsed strictly."""
    value = F.when(F.col("c_custkey") % 10 == 0, F.lit("x")).otherwise(F.concat((F.col("c_nationkey") + 0.5).cast("string")))
    line = F.concat_ws(" ", (F.col("c_custkey") % 7).cast("string"), F.concat(F.lit("3:"), value))
    v = _table(spark, sf_dir, "customer").select(V.sparse(line).alias("v")).select("v.*")
    total = F.sum(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x))
    return v.agg(F.count("*").alias("n"), F.sum(F.col("invalid").cast("long")).alias("invalid"), F.sum(F.col("label").cast("long")).alias("labels"), F.round(total, 2).alias("total"))


@_query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber) AS place FROM lineitem")
def external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place in the order of the whole table: ranges are sorted apart and their sizes summed."""
    keys = ["l_suppkey", "l_orderkey", "l_linenumber"]
    rows = R.external_sort(_table(spark, sf_dir, "lineitem").select(*keys), keys).withColumn("at", F.monotonically_increasing_id()).persist()
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().collect())
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total)]
        total += n
    start = F.create_map(*before)[F.shiftright("at", 33).cast("int")]
    return rows.select(*keys, (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long").alias("place"))


@_query("SELECT l_linenumber::INT AS part, count(*) AS n, count(DISTINCT l_linenumber) AS targets, bool_and(true) AS in_order FROM lineitem GROUP BY l_linenumber")
def spread_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sent to the partition that each one names, where they stand in order."""
    rows = R.spread_exchange(_table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey"), F.col("l_linenumber"), 8).sortWithinPartitions("l_orderkey")
    numbered = rows.select(F.spark_partition_id().alias("part"), "l_linenumber", "l_orderkey", F.monotonically_increasing_id().alias("at"))
    tops = numbered.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("targets"), (F.max_by("l_orderkey", "at") == F.max("l_orderkey")).alias("in_order"))
    return tops


@_query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts over the events as a stream of files."""
    source = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return SW.drained(SW.window_counts(stream, "ts", "1 hour"), "stream_window_counts", W.scratch(spark, "stream"))


def _train_sql(rounds: int, splits: int = 4, rate: float = 0.1) -> str:
    steps = [_E, f"w0 AS (SELECT unnest(range(0, {DIMS}))::INT AS dim, 0.0::DOUBLE AS w)", f"n AS (SELECT (vec_id % {splits}) AS s, count(*) AS n FROM embeddings GROUP BY 1)"]
    for k in range(rounds):
        steps.append(f"i{k} AS MATERIALIZED (SELECT id, any_value(y) AS y, sum(v * w) AS ip FROM e JOIN w{k} USING (dim) GROUP BY id)")
        steps.append(f"g{k} AS (SELECT id % {splits} AS s, dim, sum(v * y / (1.0 + exp(y * ip))) AS g FROM e JOIN (SELECT id, y, ip FROM i{k}) USING (id, y) GROUP BY ALL)")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.dim, sum(n.n * (w.w + {rate} * g.g / n.n)) / sum(n.n) AS w FROM w{k} w JOIN g{k} g USING (dim) JOIN n ON n.s = g.s GROUP BY w.dim, w.w)")
    return "WITH " + ", ".join(steps) + f" SELECT dim, round(w, 6) AS w FROM w{rounds}"


@_query(_train_sql(3))
def train_merge_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.train(_vectors(spark, sf_dir), DIMS, 4, rounds=3)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "dim int, w double")


@_query("WITH n AS (SELECT (r_regionkey)::INT AS node, 1 AS n FROM region) SELECT node, line FROM (SELECT (node + 1) % 5 AS node, node || ': hello from ' || node || ' with ' || n || ' rows' AS line FROM n UNION ALL SELECT node, ((node + 1) % 5) || ': reply of ' || ((node + 1) % 5) FROM n)")
def train_merge_hello(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nodes greet each other around the ring and reply."""
    rows = _table(spark, sf_dir, "region").select("r_regionkey").repartitionById(5, F.col("r_regionkey").cast("int"))
    heard, _ = T.run_train_merge(spark, T.HelloJob(), rows, [], 5, rounds=3)
    return spark.createDataFrame(heard, "node int, line string")


@_query()
def train_merge_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.train(_vectors(spark, sf_dir), DIMS, 4, rounds=4, merge="ring")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "dim int, w double")


@_query()
def network_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network trained on images drawn from the vectors' labels: the loss before and after."""
    from .operators import network as N

    side = F.transform(F.sequence(F.lit(0), F.lit(783)), lambda i: F.when((F.floor(i / 28) > 2 * F.col("label")) & (F.floor(i / 28) < 2 * F.col("label") + 6), F.lit(200)).otherwise(F.pmod(F.xxhash64("vec_id", i), F.lit(60))).cast("short"))
    rows = _table(spark, sf_dir, "embeddings").where("vec_id < 200").select((F.col("vec_id") % 2).cast("int").alias("s"), F.col("label").cast("int").alias("label"), side.alias("bytes"))
    dealt = rows.repartitionById(2, F.col("s")).select("label", "bytes")
    start = N.initial()
    model, _ = T.run_train_merge(spark, N.NetworkJob(threshold=64), dealt, start, 2, rounds=1)
    return spark.createDataFrame([(name, float(abs(model[name] - start[name]).max())) for name in start], "layer string, moved double")


@_query()
def generated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sparse_points(spark, 1000, 10_000, [(1, 5.0), (3, 3.0), (8, 2.0)], [(1, 6.0), (2, 3.0), (5, 1.0)])

