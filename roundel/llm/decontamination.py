"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = m * percent // 100 edits. Cut into k + 1
pieces, at least one piece of it must occur as it is, so an Aho-Corasick automaton over all pieces
finds every place that can match, and Myers' bit-parallel search verifies the text around it. Texts
and items are lower-cased and white space is collapsed first.

Items are broadcast in blocks of at most BLOCK_CHARS characters; a benchmark beyond that is matched
block after block. Documents stay where they are: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, read, row_hash, slices

PERCENT = 5
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, row_hash long, item_id long, distance int, budget int, stop long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """text in budget + 1 pieces of nearly equal length, with their places."""
    n = budget + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str, begin: int = 0, end: int | None = None) -> tuple[int, int]:
    """Smallest edit distance of an m-character pattern to any part of text[begin:end], and where that part ends first."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, begin
    get = peq.get
    for i in range(begin, len(text) if end is None else end):
        eq = get(text[i], 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        hp = minus | (full & ~(d | plus))
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = hp << 1 & full
        hm = hm << 1 & full
        plus = hm | (full & ~(d | hp))
        minus = hp & d
        if score < best:
            best, at = score, i + 1
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], percent: int):
        self.items = [(i, n, len(n) * percent // 100, masks(n)) for i, t in items if (n := normal(t))]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget, _) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, raw: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, budget, end in the normalised text) of every item that the text holds."""
        if not self.items:
            return []
        text = normal(raw)
        spans: dict[int, list[list[int]]] = {}
        for stop, (n, where) in self.automaton.iter(text):
            for k, at in where:
                _, item, budget, _ = self.items[k]
                begin = stop + 1 - n - at - budget
                end = begin + len(item) + 2 * budget
                of = spans.setdefault(k, [])
                if of and begin <= of[-1][1] and of[-1][0] <= end:
                    of[-1] = [min(begin, of[-1][0]), max(end, of[-1][1])]
                else:
                    of.append([begin, end])
        out = []
        for k, of in spans.items():
            name, item, budget, peq = self.items[k]
            best, at = min(best_match(peq, len(item), text, max(0, a), min(len(text), b)) for a, b in of)
            if best <= budget:
                out.append((name, best, budget, at))
        return out


#: The last matcher of this worker, with the items it was built from, which keeps their id theirs.
_last: list = []


def _find(items, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _last or _last[0] is not items.value or _last[1] != percent:
            _last[:] = [items.value, percent, Matcher(items.value, percent)]
        matcher = _last[2]
        for batch in slices(batches, "text"):
            hits = [(k, *hit) for k, text in enumerate(batch.column("text").to_pylist()) if text for hit in matcher.find(text)]
            if hits:
                at, *columns = zip(*hits, strict=True)
                rows = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "row_hash")]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["doc_id", "row_hash", "item_id", "distance", "budget", "stop"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT, least: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, row_hash, item_id, distance, budget, stop) for every item that a document holds within its budget.

    distance is the smallest of all places, stop the end of the first such place in the normalised
    text. Null or empty texts and items match nothing. An item matches inside words too, and so does a
    very short one: items of less than `least` normalised characters are left out. Long texts are
    searched whole. Repeated documents each give their rows, repeated items too; row_hash tells rows of
    one doc_id apart by their texts. An empty table on either side gives an empty result. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row_hash", row_hash(F.col("doc_id"), F.col("text")))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = [(r.item_id, r.text) for r in rows if len(normal(r.text)) >= least]
        found = docs.mapInArrow(frees(_find(spark.sparkContext.broadcast(part), percent)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_hash")
