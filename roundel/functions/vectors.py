"""Vectors as columns: parsing, products, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparse(text: Column, labelled: bool = True, pair: str = "[:=]", between: str = "[,\\s]+") -> Column:
    """`label id:value id:value ...` as struct(label, ids, vals, invalid).

    With labelled the first field is the label; a pair that isn't `number:number` makes the row invalid
    and is left out.
    """
    fields = F.filter(F.split(F.trim(text), between), lambda s: s != "")
    pairs = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))) if labelled else fields
    right = F.filter(pairs, lambda s: s.rlike(f"^[0-9]+{pair}[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))
    label = F.get(fields, F.lit(0)).try_cast("int") if labelled else F.lit(None).cast("int")
    bad = (F.size(right) < F.size(pairs)) | (label.isNull() if labelled else F.lit(False))
    return F.struct(
        label.alias("label"),
        F.transform(right, lambda s: F.get(F.split(s, pair), F.lit(0)).cast("int")).alias("ids"),
        F.transform(right, lambda s: F.get(F.split(s, pair), F.lit(1)).cast("float")).alias("vals"),
        bad.alias("invalid"),
    )


def point(text: Column) -> Column:
    """`x y`, with spaces, tabs or bars between, as struct(x, y)."""
    fields = F.split(F.trim(text), "[ |\\t]+")
    return F.struct(F.get(fields, F.lit(0)).try_cast("double").alias("x"), F.get(fields, F.lit(1)).try_cast("double").alias("y"))


def nearest(distances: Sequence[Column]) -> Column:
    """Number of the strictly smallest distance; of equal ones the first."""
    out, best = F.lit(0), distances[0]
    for i, d in enumerate(distances[1:], 1):
        out, best = F.when(d < best, i).otherwise(out), F.least(best, d)
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def scaled_tanh(x: Column) -> Column:
    return 1.7159 * F.tanh(x * (2 / 3))


def scaled_tanh_slope(y: Column) -> Column:
    """Derivative of scaled_tanh, from its value."""
    return (2 / 3 / 1.7159) * (1.7159 - y) * (1.7159 + y)


def hex_dump(data: Column) -> Column:
    """Bytes as pairs of hexadecimal digits with spaces between."""
    return F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))
