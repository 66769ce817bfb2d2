"""N-gram Jaccard join with signature trees.

A document's set is its distinct 5-word shingles. Equal sets are one class, so copies cost one row.
Classes meet in buckets: 28 keys of two minimum hashes each, which two sets of Jaccard 0.75 all miss
with a probability below 1e-10 (0.4375**28). A bucket is cut into blocks of at most BLOCK classes and
BLOCK_TOKENS tokens, ordered by size and a further minimum hash, so that alike sets stand in one block
and a hot bucket spreads over many tasks; two blocks are compared only where their size ranges allow a
link and they are not one component yet. Before whole sets move, sketches do: 16 bits of each of the 56
minimum hashes. A class goes on only if it agrees with another one of its group in LEAST of them, which
a pair of Jaccard 0.75 misses with a probability below 1e-11, and if the pair shares no smaller key, so
that two classes meet once and not in each of their buckets. Then each group is a signature tree
(signature_tree.py), which finds the links by exact comparison of whole sets of 64-bit hashes and emits
a spanning forest, never all pairs. No bucket, candidate or partner is dropped.

Buckets come in two rounds, and buckets with the same members count once. What the first keys have
linked is one component in the second round; a bucket inside one component holds nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import drop, frees, read, row_hash, slices, stored, text_buffer
from .components import components
from .signature_tree import Block

SHINGLE, PERCENT = 5, 75
BANDS, FIRST = 28, 4
LEAST = 18  # of the 2 * BANDS minimum hashes that a link's sets have in common
BLOCK, BLOCK_TOKENS = 4096, 4 << 20  # classes, and tokens of 8 bytes, that one tree holds; one larger set is a block of its own
CHAIN = 4  # a bucket of more blocks is compared along a chain of them first
CELLS = 1 << 20  # of the filter that is broadcast: 8 MB of longs at most, whatever the input
STEP = 1 << 16
A = W.mixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * W.BASE) | np.uint64(1)
B = W.mixed(A)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle; empty without words."""
    starts, ends, text = W.word_spans(buf, offsets)
    hashes = W.range_hashes(W.LOWER[buf], starts, ends)
    full, first = W.windows(hashes, text, size)
    at = np.searchsorted(text[first], np.arange(len(offsets)))
    word_at = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        if at[i] < at[i + 1]:
            out.append(np.unique(full[at[i] : at[i + 1]]))
        elif n := word_at[i + 1] - word_at[i]:
            up = W.powers(size)
            out.append(W.mixed((hashes[word_at[i] : word_at[i + 1]] * up[:n]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n)))
        else:
            out.append(full[:0])
    return out


def band_keys(tokens: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A hash of two minimum hashes for each band, and the low 16 bits of all minimum hashes."""
    low = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), STEP):
        np.minimum(low, ((tokens[k : k + STEP] ^ B[:, None]) * A[:, None]).min(axis=1), out=low)
    pair = low.reshape(BANDS, 2)
    return W.mixed(pair[:, 0] + W.mixed(pair[:, 1]) + A[:BANDS]).view(np.int64), (low >> np.uint64(16)).astype("<u2").tobytes()


def _class(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(*text_buffer(batch.column("text")))
        keys, sketches = zip(*(band_keys(s) if len(s) else (None, None) for s in sets), strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("at"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc_id", "at", "n", "c", "keys", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose set is the one that is asked for, each class once a task."""
    seen: set[int] = set()
    for batch in slices(batches, "text"):
        ids, names = batch.column("id").to_pylist(), batch.column("c").to_pylist()
        new = [k for k, i in enumerate(ids) if i not in seen]
        if not new:
            continue
        found = []
        for k, s in zip(new, shingle_sets(*text_buffer(batch.column("text").take(pa.array(new)))), strict=True):
            if ids[k] not in seen and len(s) and _class(s) == names[k]:
                found.append((ids[k], s.tobytes()))
                seen.add(ids[k])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["id", "tokens"])


def _blocks(block: int, tokens: int):
    """Sorted rows of buckets with the number of the block they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, rows, size = None, -1, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if k != key or rows == block or size + n > tokens:
                    key, number, rows, size = k, number + 1, 0, 0
                rows, size = rows + 1, size + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "n", "part")), pa.array(out, pa.int64())], names=["key", "id", "n", "part", "number"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], *values: str) -> Iterator[tuple]:
    """Sorted rows by group: its name, and for each class once its id, label, side and values."""
    key, group = None, {}
    for batch in batches:
        for k, i, *rest in zip(*(batch.column(c).to_pylist() for c in ("grp", "id", "label", "side", *values)), strict=True):
            if k != key:
                if group:
                    yield key, [*group], *map(list, zip(*group.values(), strict=True))
                key, group = k, {}
            group[i] = rest
    if group:
        yield key, [*group], *map(list, zip(*group.values(), strict=True))


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes whose sketch agrees with that of another component (and the other side) of their group, of pairs that share no smaller key of this round.

    Of buckets with the same members the one with the smallest key is kept, so a pair's smallest key always has its bucket.
    """
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["grp", "id", "label", "side"])

    none = np.iinfo(np.int64).max
    for name, ids, labels, sides, sketches, keys in _groups(batches, "sketch", "keys"):
        low, keys, bucket = np.frombuffer(b"".join(sketches), "<u2").reshape(len(ids), -1), np.array(keys), int(name.partition(":")[0])
        label, side = np.array(labels), np.array(sides) if sides[0] is not None else None
        for a in range(0, len(ids), 64):
            near = (low[a : a + 64, None] == low).sum(axis=2) >= LEAST
            near &= label[a : a + 64, None] != label
            if side is not None:
                near &= side[a : a + 64, None] != side
            i, j = np.nonzero(near)
            first = np.where(keys[a + i] == keys[j], keys[j], none).min(axis=1, initial=none)
            out += [(name, ids[k], labels[k], sides[k]) for k in np.unique(a + i[first == bucket]).tolist()]
        if len(out) > 4096:
            yield batch()
    if out:
        yield batch()


def _link(percent: int):
    """A spanning forest of the links inside each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, labels, sides, tokens in _groups(batches, "tokens"):
            sets = [np.frombuffer(t, np.uint64) for t in tokens]
            edges = Block(sets, percent, labels, sides if sides[0] is not None else None).forest() if len(ids) > 1 else ()
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in edges], pa.int64()), pa.array([ids[j] for _, j in edges], pa.int64())], names=["a", "b"])

    return run


def _fits(low: Column, high: Column, percent: int) -> Column:
    return 100 * low >= percent * high


class _Join:
    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int, block: int, tokens: int):
        self.docs, self.classes, self.percent, self.block, self.tokens = docs, classes, percent, block, tokens
        self.bands = 1, BANDS
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with the component that is known so far of the class `id`."""
        if self.labels is None:
            return rows.withColumn("label", F.col("id"))
        known = self.labels.select(F.col("node").alias("id"), F.col("label").alias("known"))
        return rows.join(known, "id", "left").withColumn("label", F.coalesce("known", "id")).drop("known")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        need = stored(self.classes.select("id", "c", F.col("at").alias("where")).join(ids, "id", "left_semi"), "wanted")
        cell = lambda x: F.pmod(F.xxhash64(x), F.lit(CELLS))
        cells = need.select(cell("where").alias("cell")).distinct()  # CELLS rows at most
        near = self.docs.join(F.broadcast(cells), cell(F.col("at")) == F.col("cell"), "left_semi")
        sets = stored(near.join(need, F.col("at") == F.col("where")).select("id", "c", "text").mapInArrow(frees(_sets), "id long, tokens binary"), "sets")
        drop(need)
        return sets

    def link(self, rows: DataFrame) -> None:
        """Compare the classes of each group: rows (grp, id, label, side)."""
        sketched = rows.join(self.classes.select("id", "sketch", F.slice("keys", *self.bands).alias("keys")), "id").repartition("grp").sortWithinPartitions("grp")
        near = stored(sketched.select("grp", "id", "label", "side", "sketch", "keys").mapInArrow(frees(_sift), "grp string, id long, label long, side int"), "near")
        sets = self.sets_of(near.select("id"))
        full = near.join(sets, "id").repartition("grp").sortWithinPartitions("grp")
        found = stored(full.select("grp", "id", "label", "side", "tokens").mapInArrow(frees(_link(self.percent)), "a long, b long"), "links")
        drop(sets, near)
        if found.isEmpty():
            drop(found)
            return
        both = found if self.edges is None else stored(self.edges.union(found), "links")
        if both is not found:
            drop(self.edges, found)
        drop(self.labels)
        self.edges, self.labels = both, components(both)

    def round(self, first: int, last: int) -> None:
        self.bands = first + 1, last - first
        p, none = self.percent, F.lit(None).cast("int")
        further = F.get("keys", F.lit(last % BANDS))  # of another band: alike sets mostly share it
        rows = self.labelled(self.classes.select("id", "n", "keys")).select("id", "n", "label", further.alias("part"), F.explode(F.slice("keys", *self.bands)).alias("key"))
        shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("id")).alias("h"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        shared = shared.where((F.col("members") > 1) & (F.col("l0") != F.col("l1")) & ((F.col("members") > 2) | _fits(F.col("low"), F.col("high"), p)))
        once = shared.groupBy("members", "tokens", "h", "low", "high").agg(F.min("key").alias("key"))  # the same members
        large = (F.col("members") > self.block) | (F.col("tokens") > self.tokens)
        active = stored(rows.join(once.select("key", large.alias("large")), "key"), "buckets")
        small = active.where("NOT large").select(F.col("key").cast("string").alias("grp"), "id", "label", none.alias("side"))
        if active.where("large").isEmpty():
            self.link(small)
            drop(active)
            return
        hot = active.where("large").select("key", "id", "n", "part").repartitionByRange("key", "n", "part", "id").sortWithinPartitions("key", "n", "part", "id")
        placed = hot.select("key", "id", "n", F.spark_partition_id().alias("part")).mapInArrow(_blocks(self.block, self.tokens), "key long, id long, n long, part int, number long")
        placed = stored(placed.select("key", "id", "n", F.concat_ws(".", "part", "number").alias("block")), "blocks")
        blocks = self.labelled(placed).select(F.concat_ws(":", F.col("key").cast("string"), "block").alias("grp"), "id", "label", none.alias("side"))
        self.link(small.unionByName(blocks))
        self.across(placed)
        drop(placed, active)

    def across(self, placed: DataFrame) -> None:
        """Compare blocks of one bucket whose size ranges allow a link between two components: where there are many, a chain of them first, which mostly joins what is one component."""
        many = placed.groupBy("key").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0]
        for chain in (True, False) if many > CHAIN else (False,):
            now = self.labelled(placed).groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l0"), F.max("label").alias("l1"))
            x, y = now.alias("x"), now.alias("y")
            may = _fits(F.col("x.high"), F.col("y.low"), self.percent) & _fits(F.col("y.high"), F.col("x.low"), self.percent)
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") < F.col("y.block")) & may & F.expr("NOT (x.l0 = x.l1 AND y.l0 = y.l1 AND x.l0 = y.l0)"))
            pairs = pairs.select("x.key", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
            if chain:
                pairs = pairs.groupBy("key", "i").agg(F.min("j").alias("j"))
            sides = F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("s")
            sides = stored(pairs.select("key", "i", "j", sides).select("key", "i", "j", "s.block", "s.side"), "block-sides")
            if not sides.isEmpty():
                rows = self.labelled(placed.join(sides, ["key", "block"]))
                self.link(rows.select(F.concat_ws(":", F.col("key").cast("string"), "i", "j").alias("grp"), "id", "label", "side"))
            drop(sides)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK, block_tokens: int = BLOCK_TOKENS, more: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id; with `more` also row_hash and kept.

    Two documents link when 100 * shared >= percent * all of their shingles; component_id is the
    smallest doc_id that links reach. A null text, or one without words, has no shingles and is its
    own component. Copies and repeated rows share a class. A row with a null doc_id is a document like
    others; a component of such rows alone has a null id. A long text is taken whole, and a set of more
    than block_tokens shingles is a block of its own. An empty table gives an empty result. Other
    columns are ignored. row_hash is a hash of the text: with doc_id it tells rows apart. kept is set
    for the first row of each component, by doc_id (nulls last) and then row_hash, and for rows equal to it.
    """
    if percent < 75:
        raise ValueError("the bucket keys are sized for 75 percent and more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("at", row_hash(F.col("doc_id"), F.col("text")))  # a place to find the text again
    features = stored(docs.mapInArrow(frees(_features), "doc_id long, at long, n long, c binary, keys array<long>, sketch binary"), "shingles")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    classes = features.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), *([F.min(first).alias("first")] if more else []))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    join = _Join(docs, classes, percent, block, block_tokens)
    join.round(0, FIRST)
    join.round(FIRST, BANDS)
    whole = join.labelled(classes.select("id", "c", "rep", *(["first"] if more else [])))
    lowest = whole.groupBy("label").agg(F.min("rep").alias("component_id"), *([F.min("first").alias("best")] if more else []))
    final = stored(whole.join(lowest, "label").select(F.col("c").alias("of"), "component_id", *(["best"] if more else [])), "components")
    drop(classes, join.edges, join.labels)
    out = features.join(final, F.col("c") == F.col("of"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if more:
        columns += [F.col("at").alias("row_hash"), (F.col("best").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.at") == F.col("at")))).alias("kept")]
    return out.select(*columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], chr(1)) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = w.doc_id
"""
