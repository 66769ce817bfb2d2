"""Options of a job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

#: What Spark does by itself: work is pulled by idle cores, slow tasks run twice, reducers take what is ready.
NATIVE = ("dynamic_map", "mappers_per_node", "dynamic", "dynamic_disable_swapping", "dynamic_disable_relocation", "dynamic_swap_time", "dynamic_debug")


@dataclass
class Options:
    paths: list[str] = field(default_factory=list)
    cache: str = "disk"  # memory, disk or none
    num_splits: int = 1
    min_split_size: int = 0
    max_split_size: int | None = None
    aggregation: str = "auto"  # none, generic, nary or auto
    agg_count: int = -1
    fan_in: int = 3
    max_rounds: int | None = None
    model_dir: str | None = None
    model_name: str = "model"
    compress_after: int = 10  # from this round on, frames and saved models are compressed
    debug: bool = False  # run in this process, with so many cores
    debug_nodes: int = 2
    disable_logging: bool = False
    master: str | None = None  # where host and ports lead to
    conf: Mapping[str, str] = field(default_factory=dict)  # Spark's own settings, spark.hadoop.* among them
    native: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.cache not in ("memory", "disk", "none"):
            raise ValueError("cache is memory, disk or none")
        if self.aggregation not in ("none", "generic", "nary", "auto"):
            raise ValueError("aggregation is none, generic, nary or auto")
        if self.aggregation == "generic" and self.agg_count < 1:
            raise ValueError("generic aggregation needs agg_count")
        if self.num_splits < 1 or self.min_split_size < 0 or self.max_split_size is not None and self.max_split_size < max(1, self.min_split_size):
            raise ValueError("num_splits is 1 or more, and max_split_size not below min_split_size")
        if self.fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        if unknown := set(self.native) - set(NATIVE):
            raise ValueError(f"unknown options: {sorted(unknown)}")
        if self.native.get("dynamic") and self.aggregation in ("none", "generic"):
            raise ValueError("dynamic needs n-ary aggregation")
        if self.native.get("dynamic_map") and not (self.native.get("dynamic") and self.aggregation in ("nary", "auto")):
            raise ValueError("dynamic_map needs dynamic and n-ary aggregation")
