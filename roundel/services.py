"""What surrounds a job: a session from options, a store of models, a status board, files on every node, memory in use."""

from __future__ import annotations

import json
import logging
import secrets
import string
from collections.abc import Mapping

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from .plans.options import Options

log = logging.getLogger("roundel")


def native_conf(options: Options) -> dict[str, str]:
    """Spark settings that do what elastic options ask for: idle cores pull work at once, slow tasks run twice, sizes are planned anew."""
    out = {"spark.sql.adaptive.enabled": "true"}
    if options.native.get("dynamic_map") or options.native.get("dynamic"):
        out["spark.locality.wait"] = "0s" if not options.native.get("dynamic_disable_relocation") else "3s"
        out["spark.speculation"] = str(not options.native.get("dynamic_disable_swapping", False)).lower()
    if wait := options.native.get("dynamic_swap_time"):
        out["spark.speculation.interval"] = f"{int(wait)}ms"
    if options.max_split_size:
        out["spark.sql.files.maxPartitionBytes"] = str(options.max_split_size)
    return out | dict(options.conf)


def session(options: Options, name: str = "roundel") -> SparkSession:
    """A session as the options say: in this process with `debug`, else at the master."""
    builder = SparkSession.builder.appName(name).master(f"local[{options.debug_nodes}]" if options.debug or not options.master else options.master)
    for key, value in native_conf(options).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if options.disable_logging:
        spark.sparkContext.setLogLevel("OFF")
    return spark


class ModelStore:
    """Models under random keys in a folder that driver and cluster share."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def put(self, model: Mapping[str, object]) -> str:
        key = "".join(secrets.choice(string.ascii_letters + string.digits) for _ in range(128))
        self.spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.directory}/{key}")
        return key

    def get(self, key: str) -> dict[str, object]:
        if not (len(key) == 128 and key.isalnum()):
            raise KeyError("no such key")
        return json.loads(self.spark.read.text(f"{self.directory}/{key}").first()[0])


class StatusBoard:
    """What running jobs say of themselves."""

    def __init__(self) -> None:
        self._status: dict[str, str] = {}
        self._done: set[str] = set()

    def set(self, job: str, status: str) -> None:
        log.debug("%s: %s", job, status)
        self._status[job] = status

    def get(self, job: str) -> str | None:
        return self._status.get(job)

    def finish(self, job: str) -> None:
        self._done.add(job)

    def finished(self, job: str) -> bool:
        return job in self._done


def distribute(spark: SparkSession, path: str) -> str:
    """A file copied to every node; its name there, for local_path."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def local_path(name: str) -> str:
    """Where a distributed file lies on the node that asks."""
    return SparkFiles.get(name)


def memory_in_use(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """(largest, left) bytes of storage memory of the driver and each executor; logged too."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    out = {str(k): (int(v._1()), int(v._2())) for k, v in ((e._1(), e._2()) for e in _scala(status))}
    for node, (most, left) in out.items():
        log.info("%s: %d of %d bytes of storage memory left", node, left, most)
    return out


def _scala(items):
    at = items.iterator()
    while at.hasNext():
        yield at.next()
