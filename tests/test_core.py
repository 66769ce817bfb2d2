import gzip
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from roundel import queries as Q
from roundel.functions import vectors as V
from roundel.operators import kmeans as K
from roundel.operators import linear as L
from roundel.operators import train_merge as T
from roundel.operators.iterate import format_report, run
from roundel.plans.options import Options
from roundel.plans.shapes import choose, heap_parents, nary_levels, spread_levels, spread_steps
from roundel.sources import scans as S
from roundel.sources import sinks as W

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NINE = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (10.0, 10.0), (11.0, 11.0), (12.0, 12.0), (20.0, 20.0), (21.0, 21.0), (22.0, 22.0)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b)


@pytest.mark.parametrize(
    ("start", "one_move", "rounds", "final", "sums"),
    [
        ([(1, 1), (2, 2), (3, 3)], False, 3, [(1, 1), (2.5, 2.5), (16, 16)], 43.84062),
        ([(1, 1), (2, 2), (3, 3)], True, 4, [(1, 1), (2.5, 2.5), (16, 16)], 43.84062),
        ([(1, 1), (10, 10), (20, 20)], False, 2, [(2, 2), (11, 11), (21, 21)], 8.485281),
        ([(1, 1), (10, 10), (20, 20)], True, 4, [(2, 2), (11, 11), (21, 21)], 8.485281),
        ([(1, 1), (100, 100), (20, 20)], False, 5, [(11, 11), (2, 2), (21, 21)], 8.485281),
        ([(1, 1), (100, 100), (20, 20)], True, 7, [(11, 11), (2, 2), (21, 21)], 8.485281),
    ],
)
def test_dense_kmeans(spark, start, one_move, rounds, final, sums):
    points = spark.createDataFrame(NINE, "x double, y double")
    model, reports = run(spark, K.KMeansJob(points, ["x", "y"], one_move=one_move), K.KMeansModel([tuple(map(float, c)) for c in start]))
    assert len(reports) == rounds
    assert [tuple(round(v, 6) for v in c) for c in model.centroids] == [tuple(map(float, c)) for c in final]
    assert model.distance_sum == pytest.approx(sums, abs=1e-5)
    assert model.examples == 9 * rounds and "round 0" in format_report(reports)


def test_perceptron_on_two_rows(spark):
    rows = spark.createDataFrame([("1 0:1 1:1 2:1",), ("0,0=-1,1=-1,2=-1",)], "t string").select(V.sparse(F.col("t")).alias("v")).select(F.when(F.col("v.label") > 0, 1.0).otherwise(-1.0).alias("y"), "v.ids", "v.vals")
    model, reports = run(spark, L.LinearJob(rows), L.LinearModel([0.0] * 3))
    assert [m for m in model.history] == [50.0, 0.0] and len(reports) == 2
    assert model.step == pytest.approx(0.81) and model.weights == [0.5] * 3


def test_sparse_parser_flags_bad_rows(spark):
    rows = spark.createDataFrame([("1:2 3:4",), ("1 5:0.5",), ("",), (None,)], "t string")
    strict = [r.v.invalid for r in rows.select(V.sparse(F.col("t")).alias("v")).collect()[:2]]
    free = rows.select(V.sparse(F.col("t"), labelled=False).alias("v")).first().v
    assert strict == [True, False] and free.ids == [1, 3] and free.vals == [2.0, 4.0]


def test_shapes():
    assert [nary_levels(*a) for a in ((1, 3), (2, 3), (6, 2), (6, 4), (8, 4), (16, 2))] == [[1], [1], [3, 2, 1], [2, 1], [2, 1], [8, 4, 2, 1]]
    assert heap_parents(8, 2) == [-1, 0, 0, 1, 1, 2, 2, 3] and heap_parents(8, 4) == [-1, 0, 0, 0, 0, 1, 1, 1]
    assert [spread_steps(n) for n in (2, 4, 8, 15, 16)] == [1, 2, 3, 4, 4]
    assert spread_levels(8) == {0: [0], 1: [1, 2, 4], 2: [3, 5, 6], 3: [7]}
    assert choose("auto", 2) == "none" and choose("auto", 3) == "nary"
    assert T.ring_targets(3, 4) == [[1, 2, 1, 2], [2, 0, 2, 0], [0, 1, 0, 1]]


def test_options_refuse_what_cannot_be():
    for bad in ({"cache": "tape"}, {"aggregation": "generic"}, {"fan_in": 1}, {"native": {"dynamic_map": True}}, {"native": {"what": 1}}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_sources_and_sinks(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt.gz"
    a.write_text("0a 1b 1c\n")
    b.write_bytes(gzip.compress(b"0b 1c 1c\n"))
    lines = S.text_lines(spark, f"{a}?start=0&len=100,{b}")
    assert {(r.split, (r.parameters or {}).get("len")) for r in lines.collect()} == {(0, "100"), (1, None)}
    counts = lines.select(F.explode(S.white_tokens(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    assert {r.word: r.n for r in counts.collect()} == {"0a": 1, "0b": 1, "1b": 1, "1c": 3}
    W.write_counts(counts, str(tmp_path / "counts"))
    assert "3\t1c" in {r.value for r in spark.read.text(str(tmp_path / "counts")).collect()}
    W.rebalance(lines.select("value"), str(tmp_path / "even"), 2, "gzip")
    assert spark.read.text(str(tmp_path / "even")).count() == 2
    W.save_model(spark, {"w": [1.5]}, str(tmp_path), "m", 3)
    assert W.load_model(spark, str(tmp_path), "m", 3) == {"w": [1.5]}
    (tmp_path / "x.idx").write_bytes(bytes([0, 0, 8, 3]) + struct.pack(">3i", 3, 1, 2) + bytes([1, 2, 3, 4, 250, 6]))
    assert [r.bytes for r in S.idx(spark, str(tmp_path / "x.idx"), 1, 2).orderBy("id").collect()] == [[3, 4], [250, 6]]
    W.write_delimited(spark.createDataFrame([(1, "a")], "k int, s string"), str(tmp_path / "d"))
    assert S.delimited(spark, str(tmp_path / "d"), "k int, s string").first() == (1, "a")
    assert S.split_plan(30, 10) == [(3 * i, 3) for i in range(10)]


def test_models_are_saved_each_round(spark, tmp_path):
    points = spark.createDataFrame(NINE, "x double, y double")
    run(spark, K.KMeansJob(points, ["x", "y"]), K.KMeansModel([(1.0, 1.0), (10.0, 10.0), (20.0, 20.0)]), Options(model_dir=str(tmp_path)))
    assert W.load_model(spark, str(tmp_path), "model", 2)["centroids"] == [[2.0, 2.0], [11.0, 11.0], [21.0, 21.0]]


def test_generators_repeat(spark):
    for make in (lambda: Q.generated_points(spark, DATA), lambda: S.gaussian_rows(spark, 100)):
        assert make().collect() == make().collect()


def test_ring_and_means():
    import numpy as np

    a, b, c = (np.array([float(x)]) for x in (0, 4, 8))
    assert T.pairwise_mean([a, b, c])[0] == 5 and T.weighted_mean([a, b], [3, 1])[0] == 1
