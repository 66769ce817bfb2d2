import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from roundel import queries as Q
from roundel import services
from roundel.functions import vectors as V
from roundel.operators import kmeans as K
from roundel.operators import linear as L
from roundel.operators import metrics as M
from roundel.operators import network as N
from roundel.operators import relational as R
from roundel.operators import train_merge as T
from roundel.operators.frames import FrameJob, Info, ObjectJob, StreamJob, _map, delayed, run_frames
from roundel.operators.iterate import IterativeJob, RecoveryAction, run
from roundel.plans.options import Options
from roundel.plans.shapes import heap_depths
from roundel.sources import scans as S
from roundel.sources import sinks as W

DATA = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class ByteSum(StreamJob):
    """Element-wise sums of fixed-size vectors of bytes, as frames."""

    def __init__(self, rows, size=4):
        self.rows, self.size = rows, size

    def parse(self, spark, options):
        return self.rows

    def map_frame(self, batches, model, info):
        total = np.zeros(self.size, np.int64)
        for batch in batches:
            total += np.array(batch.column("v").to_pylist(), np.int64).reshape(-1, self.size).sum(axis=0)
        return total.tobytes()

    def reduce_open(self, info):
        return np.zeros(self.size, np.int64)

    def reduce_receive(self, state, frame, info):
        return state + np.frombuffer(frame, np.int64)

    def reduce_close(self, state, info):
        return state.tobytes()

    def update_open(self, model, info):
        return np.zeros(self.size, np.int64)

    update_receive = reduce_receive

    def update_close(self, state, model, info):
        return model + state

    def should_terminate(self, model, info):
        return info.round >= 3

    def model_dict(self, model):
        return {"v": model.tolist()}


@pytest.mark.parametrize("options", [{"aggregation": "none"}, {"aggregation": "generic", "agg_count": 2}, {"aggregation": "nary", "fan_in": 2}, {"aggregation": "nary", "fan_in": 2, "native": {"dynamic": True}}, {"cache": "none", "compress_after": 1}, {"cache": "memory"}])
def test_pushed_frames_add_up(spark, tmp_path, options):
    rows = spark.range(0, 100, 1, 7).select(F.array(F.col("id"), F.lit(1), F.lit(2), F.col("id") * 2).alias("v"))
    model, reports = run_frames(spark, delayed(ByteSum(rows), {6: 0.1}), np.zeros(4, np.int64), Options(model_dir=str(tmp_path), **options))
    assert model.tolist() == [3 * 4950, 300, 600, 6 * 4950] and len(reports) == 3
    assert W.load_model(spark, str(tmp_path), "model", 2)["v"] == [2 * 4950, 200, 400, 4 * 4950]
    table = M.metrics(spark, reports)
    assert {(r.round, r.records) for r in M.rollup(table).where("operator = 'map'").collect()} == {(k, 100) for k in range(3)}
    assert M.duplicate_splits(table.where("operator = 'map'")).isEmpty() and "100 records" in M.format_frames(reports) and "+- map x7" in M.format_frames(reports)


class Flaky(ObjectJob):
    def __init__(self, rows, action, until):
        self.rows, self.action, self.until, self.heard = rows, action, until, []

    def parse(self, spark, options):
        return self.rows

    def map(self, rows, model, info):
        if info.node == 2 and info.rerun < self.until:
            raise ValueError("no")
        return [r["id"] for r in rows]

    def reduce(self, results, info):
        return sorted(x for part in results for x in part)

    def update(self, results, model, info):
        return self.reduce(results, info)

    def on_failed(self, completed, failed, info):
        self.heard.append((completed, failed))
        return self.action


@pytest.mark.parametrize(("action", "until", "want"), [(RecoveryAction.ACCEPT, 1, [0, 1, 2, 3, 6, 7]), (RecoveryAction.RERUN, 2, list(range(8))), (RecoveryAction.PARTIALLY_RERUN, 2, list(range(8)))])
def test_failed_splits_reach_the_job(spark, action, until, want):
    job = Flaky(spark.range(0, 8, 1, 4), action, until)
    model, reports = run_frames(spark, job, None, Options(aggregation="nary", fan_in=2))
    assert model == want and job.heard[0] == ({0, 1, 3}, {2: "ValueError: no"})
    assert reports[0].attempts == (1 if action is RecoveryAction.ACCEPT else 3) and "failed: [2]" in M.format_frames(reports)


def test_a_round_that_keeps_failing_raises(spark):
    with pytest.raises(RuntimeError, match="split.*no"):
        run_frames(spark, Flaky(spark.range(0, 8, 1, 4), RecoveryAction.PARTIALLY_RERUN, 99), None)

    class Broken(IterativeJob):
        keys, folds = ("k",), {"n": "sum"}
        parse = lambda self, spark, options: spark.range(8).selectExpr("id % 4 AS split", "id")
        map = lambda self, rows, model, context: rows.select("split", F.lit(1).alias("k"), F.when(F.col("split") == 2, F.raise_error(F.lit("broken"))).otherwise(1).cast("int").alias("n"))
        update = lambda self, results, model, context: results
        should_terminate = lambda self, model, context: True

    with pytest.raises(Exception, match="broken"):
        run(spark, Broken(), None)
    Broken.on_failed = lambda self, completed, context: RecoveryAction.ACCEPT if completed == {0, 1, 3} else 1 / 0
    model, reports = run(spark, Broken(), None)
    assert [r.n for r in model] == [6] and reports[0].splits == [0, 1, 3]


def test_a_model_of_an_earlier_round_is_refused(spark):
    shared = spark.sparkContext.broadcast((1, None))
    frames = spark.range(4).mapInArrow(_map(Flaky(None, None, 0), shared, Info(round=2), None, 10), "node int, payload binary, log binary")
    with pytest.raises(Exception, match="the model is of round 1, the task of round 2"):
        frames.collect()


def test_frame_jobs_need_all_parts():
    with pytest.raises(TypeError):
        FrameJob()
    assert heap_depths(8, 2) == [0, 1, 1, 2, 2, 2, 2, 3]


def test_train_merge_ring_and_bound(spark):
    rows = spark.range(0, 12, 1, 3)

    class Count(T.TrainMergeJob):
        def process(self, node, batches, model):
            n = sum(b.num_rows for b in batches)
            assert node.send(99, "x") is False
            node.send_around(model + n)
            return model + n

        def receive(self, node, source, message, model):
            return (model + message) / 2

    first, models = T.run_train_merge(spark, Count(), rows, 0.0, 3, rounds=2)
    assert models == {0: 8.0, 1: 8.0, 2: 8.0} and first == 8.0
    with pytest.raises(ValueError, match="partition"):
        T.run_train_merge(spark, Count(), rows, 0.0, 4)
    with pytest.raises(ValueError, match="max_bytes"):
        T.run_train_merge(spark, Count(), rows, 0.0, 3, max_bytes=1)
    assert T.spread_bound([np.zeros(2), np.full(2, 2.9)], 1.0) and not T.spread_bound([np.zeros(2), np.full(2, 3.1)], 1.0)


def test_network_gradients_and_lines():
    w = N.initial(1)
    r = np.random.default_rng(0)
    images, targets = r.uniform(-1, 1, (3, 29, 29)), N.one_hot(np.array([1, 5, 9]))
    _, g = N.gradients(w, images, targets)
    for name, at in (("c1", (3, 2)), ("c1", (25, 0)), ("c2", (77, 11)), ("f3", (600, 40)), ("f4", (100, 3))):
        old, loss = w[name][at], []
        for e in (1e-5, -1e-5):
            w[name][at] = old + e
            loss.append(N.gradients(w, images, targets)[0])
        w[name][at] = old
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-4, abs=1e-8)
    back = N.load_lines(N.save_lines(w))
    assert all((back[k] == w[k]).all() for k in w)


def test_network_learns(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(120):
        label = i % 3
        image = r.integers(0, 60, (28, 28))
        image[8 * label + 2 : 8 * label + 8, 4:24] = 220
        rows.append((label, image.ravel().tolist()))
    table = spark.createDataFrame(rows, "label int, bytes array<short>")
    dealt = table.repartition(2)
    model, _ = T.run_train_merge(spark, N.NetworkJob(threshold=16), dealt, N.initial(), 2, rounds=2)
    images = N.images_of(table.toArrow().column("bytes").combine_chunks())
    assert (N.predict(model, images) == np.array([x for x, _ in rows])).mean() > 0.9


def test_sparse_kmeans_equals_a_plain_loop(spark):
    r = np.random.default_rng(5)
    dense = np.where(r.random((40, 12)) < 0.3, r.integers(1, 9, (40, 12)), 0).astype(float)
    dense[7] = 0
    dense[7, 11] = 1
    rows = [(i, d, float(dense[i, d])) for i in range(40) for d in range(12) if dense[i, d]]
    points = spark.createDataFrame(rows, "id long, dim int, val float")
    start = K.sparse_start(spark, 4, 12, low=0, high=8)
    c = np.zeros((4, 12))
    for x in start.centroids.collect():
        c[x.cid, x.dim] = x.val
    ids = sorted({i for i, _, _ in rows})
    for _ in range(3):
        d = np.sqrt(((dense[ids][:, None] - c) ** 2).sum(axis=2))
        cid, total = d.argmin(axis=1), d.min(axis=1).sum()
        c = np.stack([dense[ids][cid == k].mean(axis=0) if (cid == k).any() else np.zeros(12) for k in range(4)])
    model = K.sparse_kmeans(points, start, 3)
    got = np.zeros((4, 12))
    for x in model.centroids.collect():
        got[x.cid, x.dim] = x.val
    assert np.allclose(got, c) and model.distance_sum == pytest.approx(total) and model.total_examples == 3 * len(ids)
    drawn = {x.val for x in K.sparse_start(spark, 2, 50, values=[(3, 1.0), (5, 1.0)]).centroids.collect()}
    assert drawn == {3.0, 5.0}


def test_linear_plans_do_not_grow_with_dimensions(spark):
    rows = spark.createDataFrame([(1.0, [0, 999_999], [1.0, 2.0]), (-1.0, [5], [3.0]), (1.0, [], [])], "y double, ids array<int>, vals array<double>")
    model, _ = run(spark, L.LinearJob(rows, "logistic", 2, -1.0), L.LinearModel([0.0] * 1_000_000))
    assert model.total == 3 and model.weights[0] > 0.5 and model.weights[5] < -1.5 and model.weights[999_999] == pytest.approx(2 * model.weights[0])
    assert 0 < L.gzip_ratio(model.weights) < 0.01
    assert L.accuracy(rows, model.weights).first() == (3, 2, 0.666667)


def test_perceptron_on_random_labels(spark):
    rows = S.gaussian_rows(spark, 200, dims=30, fields=5).select("y", "ids", "vals")
    model, reports = run(spark, L.LinearJob(rows, "perceptron", 5), L.LinearModel([0.0] * 30))
    assert model.history[-1] < model.history[0] and L.gzip_ratio(model.weights) > 0.3 and len(reports) <= 5


def test_splits_follow_paths_and_sizes(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("".join(f"line {i:05d}\n" for i in range(1000)))
    b.write_text("x\n" * 10)
    four = S.text_lines(spark, str(a), num_splits=4)
    counts = {r.split: r["count"] for r in four.groupBy("split").count().collect()}  # a line belongs to the split it begins in
    assert counts.keys() == {0, 1, 2, 3} and sum(counts.values()) == 1000 and all(248 <= n <= 252 for n in counts.values())
    assert four.select(F.spark_partition_id().alias("p"), "split").distinct().count() == 4
    sizes = S.text_lines(spark, [str(a), str(b)], num_splits=4, max_split_size=5000)
    assert {r.split: r["count"] for r in sizes.groupBy("split").count().collect()}.keys() == {0, 1, 2, 3} and sizes.count() == 1010
    assert S.split_size(100, 3) == 34 and S.split_size(100, 3, one_path=False) == S.BLOCK_SIZE and S.split_size(9, 1, 4, 10) == 10
    with pytest.raises(FileNotFoundError):
        S.text_lines(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        S.from_options(spark, Options())


def test_blocks_and_ranges(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes(range(256)) * 2)
    rows = S.blocks(spark, str(tmp_path / "x.bin"), 200).orderBy("start").collect()
    assert [(r.start, r.length, len(r.content)) for r in rows] == [(0, 200, 200), (200, 200, 200), (400, 112, 112)]
    assert b"".join(bytes(r.content) for r in rows) == bytes(range(256)) * 2
    part = S.blocks(spark, f"{tmp_path}/x.bin?start=250&len=10", 8).orderBy("start").collect()
    assert b"".join(bytes(r.content) for r in part) == (bytes(range(256)) * 2)[250:260]
    (tmp_path / "x.idx").write_bytes(bytes([0, 0, 8, 3]) + struct.pack(">3i", 3, 1, 2) + bytes([1, 2, 3, 4, 250, 6]))
    assert [r.bytes for r in S.idx(spark, f"{tmp_path}/x.idx?start=1&len=1").collect()] == [[3, 4]]


def test_generated_files(spark, tmp_path):
    W.generate(spark, str(tmp_path / "g"), 3, lambda split: (f"{split} {k}" for k in range(5000)))
    lines = S.text_lines(spark, str(tmp_path / "g"))
    assert lines.count() == 15000 and lines.select("split").distinct().count() == 3


def test_services(spark, tmp_path):
    store = services.ModelStore(spark, str(tmp_path))
    key = store.put({"w": [1, 2]})
    assert len(key) == 128 and store.get(key) == {"w": [1, 2]}
    with pytest.raises(KeyError):
        store.get("../x")
    board = services.StatusBoard()
    board.set("job", "half")
    board.finish("job")
    assert board.get("job") == "half" and board.finished("job") and board.get("other") is None
    (tmp_path / "shared.txt").write_text("hi")
    name = services.distribute(spark, str(tmp_path / "shared.txt"))
    read = F.udf(lambda _: open(services.local_path(name)).read())
    assert [r[0] for r in spark.range(2).select(read("id")).collect()] == ["hi", "hi"]
    assert all(most >= left > 0 for most, left in services.memory_in_use(spark).values())
    conf = services.native_conf(Options(aggregation="nary", native={"dynamic": True, "dynamic_swap_time": 500}, conf={"spark.x": "1"}, max_split_size=9))
    assert conf["spark.speculation"] == "true" and conf["spark.speculation.interval"] == "500ms" and conf["spark.x"] == "1" and conf["spark.sql.files.maxPartitionBytes"] == "9"
    assert services.session(Options(debug=True)).sparkContext is spark.sparkContext


def test_exchanges(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 13).alias("k"), "id")
    merged = R.merge_exchange(rows, F.col("k"), 3, ["id"]).select(F.spark_partition_id().alias("p"), "id", F.monotonically_increasing_id().alias("at")).collect()
    for p in {r.p for r in merged}:
        ids = [r.id for r in sorted(merged, key=lambda r: r["at"]) if r.p == p]
        assert ids == sorted(ids)
    assert [r.k for r in R.external_sort(rows, ["k"]).collect()] == sorted(i * 7 % 13 for i in range(100))


def test_scalar_functions(spark):
    row = spark.createDataFrame([("1|2\t 3", bytearray(b"\x00\xffa"))], "t string, b binary").select(
        V.point(F.col("t")).alias("p"), V.hex_dump(F.col("b")).alias("h"), V.scaled_tanh(F.lit(0.3)).alias("y"), V.scaled_tanh_slope(V.scaled_tanh(F.lit(0.3))).alias("s")
    ).first()
    assert tuple(row.p) == (1.0, 2.0) and row.h == "00 FF 61"
    assert row.y == pytest.approx(float(N.scaled_tanh(0.3))) and row.s == pytest.approx(float(N.scaled_tanh_slope(N.scaled_tanh(0.3))))


def test_queries_without_sql_run(spark):
    for name in set(Q.QUERIES) - set(Q.SQL):
        assert Q.QUERIES[name](spark, DATA).count() > 0
