"""Jobs over opaque partial results: any fold over a split's rows, any reduction, any update.

The map step is one task for each split (a partition of the parsed rows) and gives one frame: bytes.
Frames are folded along the chosen tree by tasks of their own, one for each node, and what is left
reaches the driver, where the model is updated. A split that fails is caught in its task and reported
with the frames that were made; the job then says whether to accept them, to run the round again or
only the failed splits. Every task adds a line to the round's log.

Three levels: FrameJob (bytes in, bytes out), StreamJob (frames are pushed one by one) and ObjectJob
(Python objects). Where columns and sums will do, iterate.py lets Catalyst plan the round instead.
"""

from __future__ import annotations

import pickle
import socket
import time
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import Options
from ..plans.shapes import choose, heap_depths, nary_levels
from ..sources.sinks import save_model
from .iterate import RecoveryAction

FRAMES = "node int, payload binary, log binary"


class StaleModel(RuntimeError):
    """A task holds a model older than its round."""


@dataclass
class Info:
    """What a task sees: its operator and place, the round, the age of its model, and which try this is."""

    operator: str = "map"
    node: int = 0
    nodes: int = 1
    level: int = 0
    round: int = 0
    model_age: int = 0
    rerun: int = 0
    recovering: bool = False
    task_attempt: int = 0
    user: dict[str, Any] = field(default_factory=dict)


@dataclass
class FrameReport:
    """One round: its tasks' log, the tree's levels, and how many tries it took."""

    round: int
    seconds: float
    attempts: int
    levels: list[int]
    log: list[dict]


class FrameJob(ABC):
    def __getstate__(self) -> dict:
        """What tasks get of a job: tables and sessions stay on the driver."""
        return {k: v for k, v in vars(self).items() if not isinstance(v, (DataFrame, SparkSession))}

    @abstractmethod
    def parse(self, spark: SparkSession, options: Options) -> DataFrame:
        """Rows; each partition is a split."""

    @abstractmethod
    def map_frame(self, batches: Iterator[pa.RecordBatch], model: Any, info: Info) -> bytes: ...

    @abstractmethod
    def reduce_frames(self, frames: Iterator[bytes], info: Info) -> bytes:
        """Applied once or more to every result, so it must be associative; frames come in the order of their nodes."""

    @abstractmethod
    def update_frames(self, frames: Iterator[bytes], model: Any, info: Info) -> Any: ...

    def should_terminate(self, model: Any, info: Info) -> bool:
        return True

    def on_failed(self, completed: set[int], failed: dict[int, str], info: Info) -> RecoveryAction:
        return RecoveryAction.RERUN

    def model_dict(self, model: Any) -> dict:
        return {"model": model}


class StreamJob(FrameJob):
    """Frames are pushed: open, receive each, close."""

    def reduce_frames(self, frames: Iterator[bytes], info: Info) -> bytes:
        state = self.reduce_open(info)
        for frame in frames:
            state = self.reduce_receive(state, frame, info)
        return self.reduce_close(state, info)

    def update_frames(self, frames: Iterator[bytes], model: Any, info: Info) -> Any:
        state = self.update_open(model, info)
        for frame in frames:
            state = self.update_receive(state, frame, info)
        return self.update_close(state, model, info)

    @abstractmethod
    def reduce_open(self, info: Info) -> Any: ...

    @abstractmethod
    def reduce_receive(self, state: Any, frame: bytes, info: Info) -> Any: ...

    @abstractmethod
    def reduce_close(self, state: Any, info: Info) -> bytes: ...

    @abstractmethod
    def update_open(self, model: Any, info: Info) -> Any: ...

    @abstractmethod
    def update_receive(self, state: Any, frame: bytes, info: Info) -> Any: ...

    @abstractmethod
    def update_close(self, state: Any, model: Any, info: Info) -> Any: ...


class ObjectJob(FrameJob):
    """Rows are dicts, results any objects that can be pickled."""

    def map_frame(self, batches: Iterator[pa.RecordBatch], model: Any, info: Info) -> bytes:
        return pickle.dumps(self.map((row for batch in batches for row in batch.to_pylist()), model, info))

    def reduce_frames(self, frames: Iterator[bytes], info: Info) -> bytes:
        return pickle.dumps(self.reduce(map(pickle.loads, frames), info))

    def update_frames(self, frames: Iterator[bytes], model: Any, info: Info) -> Any:
        return self.update(map(pickle.loads, frames), model, info)

    @abstractmethod
    def map(self, rows: Iterator[dict], model: Any, info: Info) -> Any: ...

    @abstractmethod
    def reduce(self, results: Iterator[Any], info: Info) -> Any: ...

    @abstractmethod
    def update(self, results: Iterator[Any], model: Any, info: Info) -> Any: ...


def delayed(job: FrameJob, seconds: dict[int, float]) -> FrameJob:
    """The job with its map slowed down on some splits, to see what stragglers do."""
    run = job.map_frame

    def slow(batches: Iterator[pa.RecordBatch], model: Any, info: Info) -> bytes:
        time.sleep(seconds.get(info.node, 0.0))
        return run(batches, model, info)

    job.map_frame = slow
    return job


def _pressed(frame: bytes, info: Info, after: int) -> bytes:
    return b"\1" + zlib.compress(frame) if info.round >= after else b"\0" + frame


def _plain(frame: bytes) -> bytes:
    return zlib.decompress(frame[1:]) if frame[:1] == b"\1" else frame[1:]


def _line(info: Info, began: float, records: int, size: int, error: str | None = None) -> dict:
    return {"round": info.round, "rerun": info.rerun, "operator": info.operator, "level": info.level, "node": info.node, "records": records, "bytes": size, "start_ms": int(began * 1000), "dur_ms": int((time.time() - began) * 1000), "host": socket.gethostname(), "error": error}


def _batch(rows: list[tuple[int, bytes | None, list[dict]]]) -> pa.RecordBatch:
    nodes, frames, logs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array(frames, pa.binary()), pa.array([pickle.dumps(x) for x in logs], pa.binary())], names=["node", "payload", "log"])


def _map(job: FrameJob, shared, info: Info, todo: set[int] | None, compress_after: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        me = replace(info, node=task.partitionId(), task_attempt=task.attemptNumber())
        if todo is not None and me.node not in todo:
            return
        age, model = shared.value
        me.model_age = age
        if age < me.round:
            raise StaleModel(f"the model is of round {age}, the task of round {me.round}")
        seen, began = [0, 0], time.time()

        def counted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen[0] += batch.num_rows
                seen[1] += batch.nbytes
                yield batch

        try:
            frame, error = _pressed(job.map_frame(counted(), model, me), me, compress_after), None
        except Exception as e:  # noqa: BLE001  whatever the job's code raises is a failed split, and is reported as one
            frame, error = None, f"{type(e).__name__}: {e}"[:500]
        yield _batch([(me.node, frame, [_line(me, began, *seen, error)])])

    return run


def _fold(job: FrameJob, info: Info, compress_after: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for node, group in groupby(rows, key=lambda r: r["node"]):
            me, log, size, began = replace(info, node=node), [], [0, 0], time.time()

            def frames(group=group, log=log, size=size) -> Iterator[bytes]:
                for r in group:
                    log += pickle.loads(r["log"])
                    if r["payload"] is not None:
                        size[0] += 1
                        size[1] += len(r["payload"])
                        yield _plain(r["payload"])

            every = frames()
            first = next(every, None)
            frame = None if first is None else _pressed(job.reduce_frames(_chained(first, every), me), me, compress_after)
            for _ in every:  # what the job has left
                pass
            yield _batch([(node, frame, [*log, _line(me, began, *size)])])

    return run


def _chained(first: bytes, rest: Iterable[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _reduced(job: FrameJob, frames: DataFrame, splits: int, kind: str, options: Options, info: Info) -> tuple[DataFrame, list[int]]:
    """The frames that are left for the update, and the nodes of each level."""
    if kind == "none":
        return frames, []
    if kind == "heap":
        depths = heap_depths(splits, options.fan_in)
        steps = [(splits, F.when(F.col("node").isin([i for i, d in enumerate(depths) if d == depth]), F.floor((F.col("node") - 1) / options.fan_in)).otherwise(F.col("node"))) for depth in range(max(depths), 0, -1)]
        levels = [sum(d < depth for d in depths) for depth in range(max(depths), 0, -1)]
    elif kind == "generic":
        steps, levels = [(options.agg_count, F.floor(F.col("node") * options.agg_count / splits))], [options.agg_count]
    else:
        levels = nary_levels(splits, options.fan_in)
        steps = [(n, F.floor(F.col("node") / options.fan_in)) for n in levels]
    for level, (n, node) in enumerate(steps, 1):
        dealt = frames.select(node.cast("int").alias("node"), F.col("node").alias("child"), "payload", "log").repartitionById(n, F.col("node"))
        frames = dealt.sortWithinPartitions("node", "child").drop("child").mapInArrow(_fold(job, replace(info, operator="reduce", level=level), options.compress_after), FRAMES)
    return frames, levels


def _attempt(spark: SparkSession, job: FrameJob, rows: DataFrame, splits: int, kind: str, model: tuple[int, Any], info: Info, options: Options, todo: set[int] | None) -> tuple[list[bytes], list[dict], list[int]]:
    shared = spark.sparkContext.broadcast(model)
    try:
        frames = rows.mapInArrow(_map(job, shared, info, todo, options.compress_after), FRAMES)
        left, levels = _reduced(job, frames, splits, kind, options, info)
        found = sorted(left.collect(), key=lambda r: r["node"])
    finally:
        shared.unpersist()
    return [_plain(bytes(r["payload"])) for r in found if r["payload"] is not None], [x for r in found for x in pickle.loads(r["log"])], levels


def run_frames(spark: SparkSession, job: FrameJob, model: Any, options: Options | None = None, max_attempts: int = 4) -> tuple[Any, list[FrameReport]]:
    """At least one round, until the job or max_rounds says stop. A round that fails max_attempts times raises."""
    options = options or Options()
    rows = job.parse(spark, options)
    if options.cache != "none":
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK if options.cache == "memory" else StorageLevel.DISK_ONLY)
    splits = rows.rdd.getNumPartitions()
    kind = "heap" if options.native.get("dynamic") else choose(options.aggregation, splits)
    held, info, reports = (0, model), Info(nodes=splits), []
    try:
        while True:
            began, log, frames, todo, attempt = time.time(), [], [], None, 0
            while True:
                attempt += 1
                new, lines, levels = _attempt(spark, job, rows, splits, kind, held, info, options, todo)
                log += lines
                failed = {x["node"]: x["error"] for x in lines if x["operator"] == "map" and x["error"]}
                frames += new
                if not failed:
                    break
                completed = {x["node"] for x in log if x["operator"] == "map" and not x["error"] and (todo is not None or x["rerun"] == info.rerun)}
                action = job.on_failed(completed, failed, info)
                if action is RecoveryAction.ACCEPT:
                    break
                if attempt >= max_attempts:
                    raise RuntimeError(f"round {info.round}: splits {sorted(failed)} failed {attempt} times: {next(iter(failed.values()))}")
                if action is RecoveryAction.RERUN:
                    frames, todo = [], None
                else:
                    todo = {*failed}
                info = replace(info, rerun=info.rerun + 1, recovering=True)
            held = (held[0] + 1, job.update_frames(iter(frames), held[1], replace(info, operator="update")))
            reports.append(FrameReport(info.round, time.time() - began, attempt, levels, log))
            info = replace(info, round=info.round + 1, model_age=held[0], rerun=0, recovering=False)
            if options.model_dir:
                save_model(spark, job.model_dict(held[1]), options.model_dir, options.model_name, info.round, compressed=info.round >= options.compress_after)
            if job.should_terminate(held[1], info) or options.max_rounds and info.round >= options.max_rounds:
                return held[1], reports
    finally:
        rows.unpersist()
