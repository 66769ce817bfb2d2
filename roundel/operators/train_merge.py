"""Train and merge: every split trains a copy of the model and sends it to others, which merge it into theirs.

Spark's tasks don't send messages to each other, so messages travel between rounds: in a round each node
(a partition of the rows, cached once) first receives what was sent to it in the round before, in the
order of senders, and then processes its rows, sending as it goes. A node's model is that of its last
round. The models of all nodes pass through the driver; their bytes are checked against max_bytes.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 512 << 20
STATE = "node int, model binary, sent binary, records long"


def ring_targets(nodes: int, sends: int) -> list[list[int]]:
    """To which node each node sends its 1st, 2nd, ... model: the next one around the ring, never itself."""
    return [[*_ring(me, nodes, sends)] for me in range(nodes)]


def _ring(me: int, nodes: int, sends: int) -> Iterator[int]:
    target = me
    for _ in range(sends if nodes > 1 else 0):
        target = next_target(me, target, nodes)
        yield target


def next_target(me: int, target: int, nodes: int) -> int:
    target = (target + 1) % nodes
    return (target + 1) % nodes if target == me else target


def pairwise_mean(models: Sequence[np.ndarray]) -> np.ndarray:
    """w = (w + next) / 2 in order; not associative, so the order is part of the result."""
    out = models[0]
    for m in models[1:]:
        out = (out + m) / 2
    return out


def weighted_mean(models: Sequence[np.ndarray], counts: Sequence[int]) -> np.ndarray:
    return np.average(np.stack(models), axis=0, weights=counts)


def spread_bound(models: Sequence[np.ndarray], step: float) -> bool:
    """Whether all models lie within three steps of each other, as ring targets are said to keep them; claimed, not proven."""
    stack = np.stack(models)
    return bool(np.abs(stack.max(axis=0) - stack.min(axis=0)).max() <= 3 * step)


@dataclass
class Node:
    """What a task knows of its place, and where it puts what it sends."""

    node: int
    nodes: int
    round: int = 0
    target: int = 0
    seen: int = 0
    sent: list[tuple[int, bytes]] = field(default_factory=list)

    def send(self, target: int, message: Any) -> bool:
        """False when there is no such node."""
        if not 0 <= target < self.nodes:
            return False
        self.sent.append((target, pickle.dumps(message)))
        return True

    def send_around(self, message: Any) -> bool:
        """To the next node of the ring."""
        if self.nodes < 2:
            return False
        self.target = next_target(self.node, self.target, self.nodes)
        return self.send(self.target, message)


class TrainMergeJob(ABC):
    @abstractmethod
    def process(self, node: Node, batches: Iterator[pa.RecordBatch], model: Any) -> Any:
        """The node's rows are trained on; node.send sends. Returns the model."""

    @abstractmethod
    def receive(self, node: Node, source: int, message: Any, model: Any) -> Any:
        """A message is merged into the node's model, which is returned."""

    def finish(self, models: dict[int, Any], records: dict[int, int]) -> Any:
        """The result from all nodes' models: that of the first node."""
        return models[min(models)]


def _step(job: TrainMergeJob, shared, nodes: int, round_: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, inbox = shared.value
        me = Node(TaskContext.get().partitionId(), nodes, round_)
        me.target, seen = me.node, [0]
        model = pickle.loads(models[me.node])

        def counted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen[0] += batch.num_rows
                yield batch

        for source, message in inbox.get(me.node, ()):
            model = job.receive(me, source, pickle.loads(message), model)
        model = job.process(me, counted(), model)
        yield pa.RecordBatch.from_arrays([pa.array([me.node], pa.int32()), pa.array([pickle.dumps(model)], pa.binary()), pa.array([pickle.dumps(me.sent)], pa.binary()), pa.array(seen, pa.int64())], names=["node", "model", "sent", "records"])

    return run


def run_train_merge(spark: SparkSession, job: TrainMergeJob, rows: DataFrame, model: Any, nodes: int, rounds: int = 3, max_bytes: int = MAX_BYTES) -> tuple[Any, dict[int, Any]]:
    """rows: partition k is node k's split. Returns what the job makes of the nodes' models, and those models.

    What is sent in the last round is received before the job finishes.
    """
    if rows.rdd.getNumPartitions() != nodes:
        raise ValueError("rows need a partition for each node")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    models, inbox, records = dict.fromkeys(range(nodes), pickle.dumps(model)), {}, {}
    try:
        for k in range(rounds):
            if (size := sum(map(len, models.values())) + sum(len(m) for box in inbox.values() for _, m in box)) > max_bytes:
                raise ValueError(f"models and messages of {size} bytes exceed max_bytes")
            shared = spark.sparkContext.broadcast((models, inbox))
            found = sorted(rows.mapInArrow(_step(job, shared, nodes, k), STATE).collect(), key=lambda r: r["node"])
            shared.unpersist()
            models, box = {r["node"]: bytes(r["model"]) for r in found}, defaultdict(list)
            records = {r["node"]: records.get(r["node"], 0) + r["records"] for r in found}
            for r in found:
                for target, message in pickle.loads(r["sent"]):
                    box[target].append((r["node"], message))
            inbox = dict(box)
    finally:
        rows.unpersist()
    last = {n: pickle.loads(m) for n, m in models.items()}
    for n in sorted(inbox):
        for source, message in inbox[n]:
            last[n] = job.receive(Node(n, nodes, rounds), source, pickle.loads(message), last[n])
    return job.finish(last, records), last


class HelloJob(TrainMergeJob):
    """Every node greets the next one around the ring and answers greetings: models are lists of what was heard."""

    def process(self, node: Node, batches: Iterator[pa.RecordBatch], model: list[str]) -> list[str]:
        for batch in batches:
            node.seen += batch.num_rows
        if node.round == 0:
            node.send_around(f"hello from {node.node} with {node.seen} rows")
        return model

    def receive(self, node: Node, source: int, message: str, model: list[str]) -> list[str]:
        if message.startswith("hello"):
            node.send(source, f"reply of {node.node}")
        return [*model, f"{source}: {message}"]

    def finish(self, models: dict[int, list[str]], records: dict[int, int]) -> list[tuple[int, str]]:
        return [(n, line) for n in sorted(models) for line in models[n]]


class LogisticJob(TrainMergeJob):
    """Logistic weights: each round a node takes one step along its split's mean gradient.

    merge: "weighted" averages all nodes by their rows after every round (rows (y, x), whole batches at
    once); "ring" sends each node's model around the ring, where it is averaged with the receiver's.
    """

    def __init__(self, rate: float = 0.1, merge: str = "weighted"):
        self.rate, self.merge = rate, merge

    def process(self, node: Node, batches: Iterator[pa.RecordBatch], model: np.ndarray) -> np.ndarray:
        g, n = np.zeros_like(model), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(over="ignore"):
                g += x.T @ (y / (1 + np.exp(y * (x @ model))))
            n += batch.num_rows
        model = model + self.rate * g / max(n, 1)
        if self.merge == "ring":
            node.send_around(model)
        return model

    def receive(self, node: Node, source: int, message: np.ndarray, model: np.ndarray) -> np.ndarray:
        return pairwise_mean([model, message])

    def finish(self, models: dict[int, np.ndarray], records: dict[int, int]) -> np.ndarray:
        some = [n for n in sorted(models) if records.get(n)]
        return weighted_mean([models[n] for n in some], [records[n] for n in some]) if some else models[min(models)]


def train(rows: DataFrame, dims: int, splits: int, rounds: int = 3, rate: float = 0.1, merge: str = "weighted") -> np.ndarray:
    """Logistic weights for rows (id, y, x); split = id mod splits."""
    spark, w = rows.sparkSession, np.zeros(dims)
    dealt = rows.select(F.pmod("id", F.lit(splits)).cast("int").alias("split"), F.col("y").cast("double").alias("y"), "x").repartitionById(splits, F.col("split")).select("y", "x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if merge == "ring":
            return run_train_merge(spark, LogisticJob(rate, merge), dealt, w, splits, rounds)[0]
        for _ in range(rounds):  # all models are averaged between rounds
            w, _ = run_train_merge(spark, LogisticJob(rate), dealt, w, splits, 1)
        return w
    finally:
        dealt.unpersist()
