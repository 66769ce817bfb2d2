"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lower-cased, digits alike, white space collapsed) and hashed; a line
counts once for each document of a host. Lines on more than MIN_DOCS documents of a host go, however
large the host is, and a document that has too few words left goes with them. Counts cover all rows:
they are aggregated before the shuffle, so a line on a third of all documents costs one row for each
task. The frequent lines are broadcast where they are at most BROADCAST_LINES, and joined to the rows
that hold them where they are more; texts are read twice and stored never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import frees, read, slices, stored, text_buffer

MIN_DOCS = 20  # a line may be on so many documents of a host
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_LEFT = 0.5  # share of its words that a document must keep
BROADCAST_LINES = 1 << 18  # 8 bytes each
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = "doc_id long, host long, k1 long, k2 long, lines array<long>"


@dataclass
class Parsed:
    """Words of some texts, and those of their lines that have words."""

    buf: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        buf, offsets = self.buf, self.offsets
        self.n = len(offsets) - 1
        self.starts, self.ends, self.text = W.word_spans(buf, offsets)
        breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buf == 10) + 1]))
        line = np.searchsorted(breaks, self.starts, "right") - 1
        self.begin = np.flatnonzero(np.diff(line, prepend=-1))  # the first word of each line
        self.size = np.diff(np.append(self.begin, len(line)))  # its words
        self.line_text = self.text[self.begin]
        self.line_start, self.line_stop = breaks[line[self.begin]], np.append(breaks[1:], len(buf))[line[self.begin]]

    def of_text(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        return hashes ^ W.mixed(text.astype(np.uint64) + np.uint64(1))

    def normal_lines(self) -> np.ndarray:
        """Hash of each normalised line."""
        return W.folded(W.range_hashes(W.FOLDED[self.buf], self.starts, self.ends), self.size)

    def counts(self) -> dict[str, np.ndarray]:
        """The five counts of each text."""
        buf, offsets, text = self.buf, self.offsets, self.text
        out = {"n_words": np.bincount(text, minlength=self.n)}
        out["word_chars"] = W.per_text(((buf & 0xC0) != 0x80) & ~W.SPACE[buf], offsets)
        out["n_symbols"] = W.per_text(SYMBOL[buf], offsets)

        repeated, first = W.windows(W.range_hashes(buf, self.starts, self.ends), text, WINDOW)
        key = self.of_text(repeated, text[first])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(mark, first[twice], 1)
        np.add.at(mark, first[twice] + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(text[np.cumsum(mark)[:-1] > 0], minlength=self.n)

        stop = self.line_stop - ((self.line_stop > 0) & (buf[np.maximum(self.line_stop - 1, 0)] == 10)) if len(buf) else self.line_stop
        _, at = np.unique(self.of_text(W.range_hashes(buf, self.line_start, stop), self.line_text), return_index=True)
        out["n_dup_lines"] = np.bincount(self.line_text, minlength=self.n) - np.bincount(self.line_text[at], minlength=self.n)
        return {c: out[c].astype(np.int64) for c in COUNTS}

    def distinct_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each text's distinct normalised lines, by text."""
        h = self.normal_lines()
        order = np.lexsort((h, self.line_text))
        t, h = self.line_text[order], h[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        return t[new], h[new]

    def without(self, hashes: np.ndarray, cut: np.ndarray) -> tuple[dict[int, str], np.ndarray, np.ndarray]:
        """Texts that lose lines where `cut` is set, and for each text its distinct lines cut and its words left."""
        buf, offsets, t = self.buf, self.offsets, self.line_text
        left = np.bincount(t[~cut], self.size[~cut], self.n).astype(np.int64)
        if not cut.any():
            return {}, np.zeros(self.n, np.int64), left
        _, at = np.unique(self.of_text(hashes, t)[cut], return_index=True)
        mark = np.zeros(len(buf) + 1, np.int8)
        np.add.at(mark, self.line_start[cut], 1)
        np.add.at(mark, self.line_stop[cut], -1)
        keep = np.cumsum(mark, dtype=np.int8)[:-1] == 0
        stop = self.line_stop[cut]
        open_end = {*t[cut][(stop == offsets[t[cut] + 1]) & (buf[stop - 1] != 10)].tolist()}  # the last line went, so the break before it goes
        out = {}
        for i in np.unique(t[cut]).tolist():
            a, b = offsets[i], offsets[i + 1]
            out[i] = buf[a:b][keep[a:b]].tobytes().removesuffix(b"\n" if i in open_end else b"").decode()
        return out, np.bincount(t[cut][at], minlength=self.n), left


def _keys(host: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for a host and a line."""
    return W.mixed(hashes ^ W.mixed(host.view(np.uint64)))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        t, h = Parsed(*text_buffer(batch.column("text"))).distinct_lines()
        at = np.searchsorted(t, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "k1", "k2")), lists], names=["doc_id", "host", "k1", "k2", "lines"])


def _clean(frequent, texts: bool):
    """frequent: a broadcast of sorted keys, or None where each row brings its own in `cut`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            page = Parsed(*text_buffer(batch.column("text")))
            hashes = page.normal_lines()
            if frequent is not None:
                host = batch.column("host").to_numpy()
                at = np.searchsorted(frequent.value, keys := _keys(host[page.line_text], hashes))
                cut = frequent.value[np.minimum(at, len(frequent.value) - 1)] == keys if len(frequent.value) else np.zeros(len(hashes), bool)
            else:
                lists = batch.column("cut")
                of = np.repeat(np.arange(batch.num_rows), [len(x) if x is not None else 0 for x in lists.to_pylist()])
                named = page.of_text(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), of)
                cut = np.isin(page.of_text(hashes, page.line_text), named)
            new, n_cut, left = page.without(hashes, cut)
            counts = page.counts()
            columns = {"doc_id": batch.column("doc_id"), **{c: pa.array(counts[c]) for c in COUNTS}, "n_cut_lines": pa.array(n_cut), "n_words_left": pa.array(left)}
            if texts:
                whole = batch.column("text")
                columns["text"] = pa.array([new.get(i, x) for i, x in enumerate(whole.to_pylist())], pa.string()) if new else whole.cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return run


def frequent_lines(lines: DataFrame, twins: DataFrame, min_docs: int) -> DataFrame:
    """(host, h) of lines on more than min_docs documents of a host; twins: documents (doc_id, host) of more than one row."""
    one = lines
    if not twins.isEmpty():  # rows of one document count a line once
        mark = twins.select(F.col("doc_id").alias("of"), F.col("host").alias("at"))
        same = (F.col("doc_id") == F.col("of")) & (F.col("host") == F.col("at"))
        one = lines.join(mark, same, "left_anti")
    each = one.select("host", F.explode("lines").alias("h"))
    if one is not lines:
        each = each.unionByName(lines.join(mark, same, "left_semi").select("doc_id", "host", F.explode("lines").alias("h")).distinct().select("host", "h"))
    return each.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs).select("host", "h")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, texts: bool = True, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row for each row of docs: doc_id, text without its frequent lines, the five counts, base_failed, n_cut_lines, n_words_left, kept.

    The counts are those of the whole text. A null or empty text has no words, so it fails. A null
    host is a host of its own. Rows of one doc_id are one document when lines are counted, and are
    judged each by its own text; a row without an id is a document of its own. A long text is taken
    alone, whole. An empty table gives an empty result. Other columns of docs are ignored, whatever
    their names. Without `texts` the texts are cut all the same and then left out.
    """
    host, text = F.col(host_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(host, host.isNull()).alias("host"), text.alias("text"))
    keyed = rows.withColumns({"k1": F.xxhash64("host", "text"), "k2": F.xxhash64("text", "host", F.lit(1))})  # equal for equal texts of one host alone
    lines = stored(keyed.mapInArrow(frees(_lines), LINES), "lines")
    twins = stored(lines.where("doc_id IS NOT NULL").groupBy("doc_id", "host").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twins")
    frequent = stored(frequent_lines(lines, twins, min_docs), "frequent-lines")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_cut_lines", "n_words_left")) + (", text string" if texts else "")
    if frequent.count() <= broadcast_lines:
        found = frequent.toArrow()
        keys = np.sort(_keys(*(np.asarray(found.column(c).to_numpy(), np.int64).view(np.uint64) for c in ("host", "h"))))
        out = rows.mapInArrow(frees(_clean(docs.sparkSession.sparkContext.broadcast(keys), texts)), schema)
    else:
        each = lines.select("host", "k1", "k2", F.explode("lines").alias("h"))
        lost = each.join(frequent, ["host", "h"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("cut"))
        out = keyed.join(lost, ["k1", "k2"], "left").select("doc_id", "text", "cut").mapInArrow(frees(_clean(None, texts)), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words_left")
    return out.select(
        "doc_id", *(["text"] if texts else []), *COUNTS, failed.alias("base_failed"), "n_cut_lines", "n_words_left",
        (~failed & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def line_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of clean_lines without their texts."""
    return clean_lines(docs, id_col, text_col, host_col, min_docs, min_left, texts=False)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
q AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(1)) AS win FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM q),
v AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
n AS (SELECT doc_id, host, line, len(ws) AS w, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm FROM m WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
f AS (SELECT host, norm, count(DISTINCT doc_id) AS c FROM n GROUP BY host, norm),
cut AS (SELECT host, norm FROM f WHERE c > 20),
lost AS (SELECT n.doc_id, count(DISTINCT n.norm) AS lines, sum(n.w) AS w FROM n JOIN cut ON n.host IS NOT DISTINCT FROM cut.host AND n.norm = cut.norm GROUP BY n.doc_id),
o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost.lines, 0)::BIGINT AS n_cut_lines, (len(ws) - coalesce(lost.w, 0))::BIGINT AS n_words_left
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_cut_lines, n_words_left,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= 20 AND n_words_left >= 0.5 * n_words) AS kept
FROM o
"""
