"""Sources: paths with parameters, text, tokens, typed delimited files, binary blocks, IDX, generators."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import parse_qsl

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import Options

#: Fixed value: the characters besides white space that end a word.
PUNCTUATION = ".,!@#$%^&*()+=:;\"'{}[]|\\/<>?~`"
WHITE = r"[ \t\r\n]+"


def split_path(path: str) -> tuple[str, dict[str, str]]:
    """A path and the parameters behind its `?`."""
    base, _, query = path.partition("?")
    return base, dict(parse_qsl(query, keep_blank_values=True))


BLOCK_SIZE = 128 << 20


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files that Spark would read at a path, and their bytes, by name; contents aren't read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(at) or ():
        for f in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if not f.isDirectory() and not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def split_plan(length: int, splits: int) -> list[tuple[int, int]]:
    """(start, length) of so many splits of a file."""
    size = -(-length // splits)
    return [(a, min(size, length - a)) for a in range(0, length, size)]


def split_size(total: int, num_splits: int = 1, min_size: int = 0, max_size: int | None = None, one_path: bool = True) -> int:
    """Bytes of a split: an even share of the one path when num_splits asks for it, else a block within the two sizes."""
    if num_splits > 1 and one_path:
        return max(1, -(-total // num_splits))
    return max(1, min_size, min(max_size or BLOCK_SIZE, BLOCK_SIZE))


def sized(spark: SparkSession, size: int) -> SparkSession:
    """A session of the same application that cuts files into splits of this many bytes, one for each task."""
    other = spark.newSession()
    for key, value in {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size, "spark.sql.files.minPartitionNum": 1}.items():
        other.conf.set(key, str(value))
    return other


def text_lines(spark: SparkSession, paths: str | Sequence[str], num_splits: int = 1, min_split_size: int = 0, max_split_size: int | None = None) -> DataFrame:
    """(value, split, path, parameters) of all lines; compressed files are read by their extension, whole.

    Paths may carry parameters behind a `?`. Each file is cut where Spark's reader cuts it, at ends of
    lines: into num_splits of one path, or by the two sizes. split numbers the parts in the order of
    paths, files and places, so a line's split is the same whenever it is read.
    """
    paths = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths)]
    out, before = None, 0
    for path in paths:
        base, parameters = split_path(path)
        files = file_sizes(spark, base)
        if not files:
            raise FileNotFoundError(base)
        size = split_size(sum(n for _, n in files), num_splits, min_split_size, max_split_size, len(paths) == 1)
        first = {}
        for name, n in files:
            first[re.sub("^([a-z0-9]+:)/+", r"\1/", name)] = before
            before += 1 if name.endswith((".gz", ".zst", ".deflate", ".snappy")) else max(1, -(-n // size))
        pairs = [F.lit(x) for kv in parameters.items() for x in kv]
        starts = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
        number = starts[F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+:)/+", "$1/")] + F.floor(F.col("_metadata.file_block_start") / size)
        rows = sized(spark, size).read.text(base).select("value", number.cast("int").alias("split"), F.lit(base).alias("path"), (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("parameters"))
        out = rows if out is None else out.unionByName(rows)
    return out


def from_options(spark: SparkSession, options: Options) -> DataFrame:
    """The lines that the options name, in the splits that they ask for."""
    if not options.paths:
        raise ValueError("no input paths")
    return text_lines(spark, options.paths, options.num_splits, options.min_split_size, options.max_split_size)


def byte_range(content: Column, start: Column | int, length: Column | int) -> Column:
    """Bytes [start, start + length) of a binary column, as far as it has them."""
    at = F.lit(start) if isinstance(start, int) else start
    n = F.lit(length) if isinstance(length, int) else length
    return F.substring(content, at.cast("int") + 1, n.cast("int"))


def blocks(spark: SparkSession, path: str, size: int = 65536) -> DataFrame:
    """(path, start, length, content): files in blocks of so many bytes, without regard to lines; parameters start and len of the path bound what is read.

    Spark's binary source reads a file as one value, so a file is one task's work and below 2 GB.
    """
    base, parameters = split_path(path)
    files = spark.read.format("binaryFile").load(base).select("path", "length", "content")
    low = F.least(F.lit(int(parameters.get("start", 0))).cast("long"), F.col("length"))
    high = F.least(low + int(parameters["len"]), F.col("length")) if "len" in parameters else F.col("length")
    at = F.explode(F.when(low < high, F.sequence(low, high - 1, F.lit(size).cast("long"))).otherwise(F.expr("cast(array() as array<long>)"))).alias("start")
    rows = files.select("path", "content", high.alias("stop"), at).withColumn("n", F.least(F.lit(size).cast("long"), F.col("stop") - F.col("start")))
    return rows.select("path", "start", F.col("n").alias("length"), byte_range(F.col("content"), F.col("start"), F.col("n")).alias("content"))


def white_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def lower_tokens(text: Column) -> Column:
    """Words of A-Z, a-z, 0-9 and underscores, in lower case; all else is between words."""
    return F.transform(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda t: t != ""), F.lower)


def word_tokens(text: Column) -> Column:
    """Words between white space and punctuation."""
    inside = "".join("\\" + c for c in PUNCTUATION)
    return F.filter(F.split(text, f"[\\s{inside}]+"), lambda t: t != "")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep)


def _idx(start: int, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                dims = data[3]
                shape = struct.unpack(f">{dims}i", data[4 : 4 + 4 * dims])
                size = int(np.prod(shape[1:], dtype=np.int64)) if dims > 1 else 1
                end = shape[0] if count is None else min(shape[0], start + count)
                body = np.frombuffer(data, np.uint8, offset=4 + 4 * dims).reshape(shape[0], size)
                for k in range(start, end, 4096):  # a few thousand items at a time
                    items = body[k : min(k + 4096, end)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(items)), pa.array(range(k, k + len(items)), pa.int64()), pa.array(items.astype(np.int16).tolist(), pa.list_(pa.int16()))], names=["path", "id", "bytes"])

    return run


def idx(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Items of IDX files (images or labels): path, id, bytes 0 to 255. Parameters start and len of the path say which items; a file is one task's work."""
    base, parameters = split_path(path)
    start = int(parameters.get("start", start))
    count = int(parameters["len"]) if "len" in parameters else count
    return spark.read.format("binaryFile").load(base).select("path", "content").mapInArrow(_idx(start, count), "path string, id long, bytes array<short>")


def from_histogram(draw: Column, histogram: Sequence[tuple[int, float]]) -> Column:
    """A value of the histogram for a uniform draw in [0, 1)."""
    total, acc, out = sum(c for _, c in histogram), 0.0, F.lit(histogram[-1][0])
    steps = []
    for value, count in histogram:
        acc += count / total
        steps.append((value, acc))
    for value, upto in reversed(steps[:-1]):
        out = F.when(draw < upto, value).otherwise(out)
    return out


def sparse_points(spark: SparkSession, rows: int, dims: int, nnz: Sequence[tuple[int, float]], values: Sequence[tuple[int, float]], labelled: bool = True, seed: int = 1000) -> DataFrame:
    """Synthetic sparse rows whose number of entries and values follow two histograms: (id, label, ids, vals).

    Every number is a hash of the row and its place, so a lost partition comes back the same.
    """
    uniform = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    base = spark.range(rows).withColumn("n", from_histogram(uniform(F.col("id"), F.lit(0)), nnz))
    at = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.expr("cast(array() as array<int>)"))
    ids = F.array_sort(F.array_distinct(F.transform(at, lambda k: F.floor(uniform(F.col("id"), k) * dims).cast("int"))))
    rows_ = base.withColumn("ids", ids)
    vals = F.transform("ids", lambda k: from_histogram(uniform(F.col("id"), k, F.lit(7)), values).cast("float"))
    label = F.when(uniform(F.col("id"), F.lit(-1)) < 0.5, 0).otherwise(1) if labelled else F.lit(None).cast("int")
    return rows_.select("id", label.alias("label"), "ids", vals.alias("vals"))


def gaussian_rows(spark: SparkSession, rows: int = 10000, dims: int = 100, fields: int = 10, shift: float = 0.7, seed: int = 42) -> DataFrame:
    """(id, y, ids, vals): y alternates from -1, values are normal around y * shift (Box and Muller)."""
    u = lambda k, c: (F.pmod(F.xxhash64("id", k, F.lit(c), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    y = F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)
    at = F.sequence(F.lit(1), F.lit(fields))
    vals = F.transform(at, lambda k: F.sqrt(-2 * F.ln(u(k, 1))) * F.cos(2 * F.pi() * u(k, 2)) + y * shift)
    ids = F.transform(at, lambda k: F.floor(u(k, 3) * dims).cast("int"))
    return spark.range(rows).select("id", y.alias("y"), ids.alias("ids"), vals.alias("vals"))
