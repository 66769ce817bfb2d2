"""Shapes of aggregation and of model distribution, as plain lists."""

from __future__ import annotations


def nary_levels(leaves: int, fan_in: int) -> list[int]:
    """Nodes on each level of an n-ary aggregation tree, the last one being the root."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    levels, n = [], leaves
    while not levels or n > 1:
        n = max(1, -(-n // fan_in))
        levels.append(n)
    return levels


def heap_parents(nodes: int, arity: int) -> list[int]:
    """Parent of each node when nodes fill a heap; the root has -1."""
    if arity < 2:
        raise ValueError("arity must be at least 2")
    return [-1, *((i - 1) // arity for i in range(1, nodes))]


def spread_levels(nodes: int) -> dict[int, list[int]]:
    """Nodes by the step in which a model reaches them when every owner feeds one new node a step."""
    out, owners, step = {0: [0]}, 1, 0
    parent_step = {0: 0}
    while owners < nodes:
        step += 1
        for i in range(owners, min(2 * owners, nodes)):
            parent_step[i] = parent_step[i - owners] + 1
        owners = min(2 * owners, nodes)
    for i in range(1, nodes):
        out.setdefault(parent_step[i], []).append(i)
    return out


def spread_steps(nodes: int) -> int:
    return max(0, (nodes - 1).bit_length())


def choose(kind: str, partitions: int) -> str:
    """`auto` is flat below three partitions and n-ary from there."""
    if kind not in ("auto", "none", "generic", "nary"):
        raise ValueError(f"unknown aggregation {kind!r}")
    return ("none" if partitions < 3 else "nary") if kind == "auto" else kind


def heap_depths(nodes: int, arity: int) -> list[int]:
    """How far each node of a heap is below its root."""
    out: list[int] = []
    for parent in heap_parents(nodes, arity):
        out.append(0 if parent < 0 else out[parent] + 1)
    return out
