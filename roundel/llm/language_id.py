"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

A text is its UTF-8 bytes in windows of WINDOW; a forward and a backward network read each window, and
their states together label every byte. The text's probabilities are the mean over all its bytes, so
the whole text counts. Training is by backpropagation through time with Adam, on the driver, on a
sample of labelled rows: an equal share of TRAIN_DOCS rows and TRAIN_BYTES bytes for each language, in
the order of a hash of the row, each row with all its windows or not at all; a row that no longer fits
is passed over. The TRAIN_LANGS languages of most rows are learned. Windows are cut where the rows are,
and every step draws as many from each language. The weights, some 60 KB, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, read, slices, text_buffer

WINDOW, HIDDEN, PAD = 64, 8, 256
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LANGS = 2000, 16 << 20, 256
STEPS, BATCH, RATE = 600, 128, 0.02
CHUNK = 2048  # windows that are read at once
UNKNOWN = "und"
HOLD, OUT = 4, 2  # documents whose crc32(id) mod HOLD is OUT are not learned from

Weights = dict[str, np.ndarray]


def windows_of(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(WINDOW, n) byte values, PAD behind a window's end."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    inside = np.arange(WINDOW)[:, None] < lengths[None, :]
    return np.where(inside, buf[np.minimum(at, max(len(buf) - 1, 0))].astype(np.int64), PAD)  # wide first: PAD is no byte


def initial(classes: int, seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    return {"x": draw(2, PAD + 1, 3 * HIDDEN), "u": draw(2, HIDDEN, 3 * HIDDEN), "o": draw(2, HIDDEN, classes), "b": np.zeros(classes, np.float32)}


def _held(w: Weights) -> np.ndarray:
    """Input weights whose PAD row keeps the state as it is."""
    x = w["x"].copy()
    x[:, PAD] = 0
    x[:, PAD, :HIDDEN] = 40
    return x.reshape(2 * (PAD + 1), 3 * HIDDEN)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def forward(w: Weights, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (2, T, n, HIDDEN) of both directions; the second reads backwards. keep gets what backpropagation needs."""
    steps, n = data.shape
    table, rows = _held(w), np.stack([data, data[::-1] + PAD + 1], axis=1)
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((2, steps, n, HIDDEN), np.float32)
    for t in range(steps):
        x = table[rows[t]]
        a = np.matmul(h, w["u"])
        gates = _sigmoid(x[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        new = np.tanh(x[..., 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, new, a[..., 2 * HIDDEN :], rows[t]))
        h = new + z * (h - new)
        states[0, t], states[1, steps - 1 - t] = h[0], h[1]
    return states


def labels(w: Weights, states: np.ndarray) -> np.ndarray:
    """Probabilities (T, n, classes) of every position."""
    p = states[0] @ w["o"][0] + states[1] @ w["o"][1] + w["b"]
    p -= p.max(axis=-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=-1, keepdims=True)
    return p


def gradients(w: Weights, data: np.ndarray, target: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
    steps, n = data.shape
    kept: list = []
    states = forward(w, data, kept)
    p = labels(w, states)
    real = (data != PAD).astype(np.float32)
    total = real.sum()
    loss = float(-(np.log(p[:, np.arange(n), target] + 1e-9) * real).sum() / total)
    d = p.copy()
    d[:, np.arange(n), target] -= 1
    d *= (real / total)[..., None]
    flat = d.reshape(-1, d.shape[-1])
    g = {"o": np.stack([states[k].reshape(-1, HIDDEN).T @ flat for k in (0, 1)]), "b": flat.sum(axis=0), "u": np.zeros_like(w["u"])}
    out = np.stack([d @ w["o"][0].T, (d @ w["o"][1].T)[::-1]], axis=1)  # in each direction's own order
    dx = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
    dh = np.zeros((2, n, HIDDEN), np.float32)
    back = w["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, new, a, _ = kept[t]
        dh += out[t]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=-1)
        da = np.concatenate([dz, dr, dn * r], axis=-1)
        g["u"] += np.matmul(h.transpose(0, 2, 1), da)
        dh = dh * z + np.matmul(da, back)
    rows = np.concatenate([k[5].ravel() for k in kept])
    values = dx.reshape(-1, 3 * HIDDEN)
    g["x"] = np.stack([np.bincount(rows, values[:, c], 2 * (PAD + 1)) for c in range(3 * HIDDEN)], axis=1).astype(np.float32).reshape(w["x"].shape)
    g["x"][:, PAD] = 0
    return loss, g


def cut_windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and length of every window of every text."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    starts = offsets[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return text, starts, np.minimum(offsets[text + 1] - starts, WINDOW)


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> tuple[list[str], Weights]:
    """Learned languages, sorted, and the weights, from whole texts."""
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    text, starts, lengths = cut_windows(buf, offsets)
    return train_windows(windows_of(buf, starts, lengths), [langs[i] for i in text.tolist()], sorted(set(langs)), steps, seed)


def train_windows(data: np.ndarray, langs: list[str], names: list[str], steps: int = STEPS, seed: int = 7) -> tuple[list[str], Weights]:
    """names, and the weights that Adam finds from windows (WINDOW, n) of these languages; each step draws languages evenly."""
    w = initial(len(names), seed)
    if not data.size:
        return names, w
    number = {name: k for k, name in enumerate(names)}
    target = np.array([number[x] for x in langs])
    order = np.argsort(target, kind="stable")
    there = np.unique(target)
    begin, count = np.searchsorted(target[order], there), np.bincount(target)[there]
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        k = r.integers(0, len(there), BATCH)
        pick = order[begin[k] + (r.random(BATCH) * count[k]).astype(np.int64)]
        _, g = gradients(w, data[:, pick], target[pick])
        rate = RATE * (1 - 0.95 * step / steps)
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return names, w


def probabilities(w: Weights, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities of each text; zeros for an empty one."""
    sizes = np.diff(offsets)
    text, starts, lengths = cut_windows(buf, offsets)
    total = np.zeros((len(sizes), len(w["b"])))
    for k in range(0, len(text), CHUNK):
        data = windows_of(buf, starts[k : k + CHUNK], lengths[k : k + CHUNK])
        p = labels(w, forward(w, data))
        np.add.at(total, text[k : k + CHUNK], np.einsum("tnk,tn->nk", p, (data != PAD).astype(np.float32)))
    return total / np.maximum(sizes, 1)[:, None]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = model.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            known = np.array([bool(names) and t is not None and any(c.isalpha() for c in t) for t in texts], bool)
            if names:
                p = probabilities(w, *text_buffer(batch.column("text")))
                best = p.argmax(axis=1)
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                found = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            else:
                score, found = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HOLD == OUT, F.lit(False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        buf, offsets = text_buffer(batch.column("text"))
        text, starts, lengths = cut_windows(buf, offsets)
        cut = pa.array([buf[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(text)), batch.column("h").take(pa.array(text)), pa.array(starts - offsets[text]), cut], names=["lang", "h", "start", "bytes"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES, limit_langs: int = TRAIN_LANGS) -> tuple[list[str], Weights]:
    """A model from a sample of labelled rows that aren't held out; nothing is learned from none.

    The sample is bounded by `limit` rows and `limit_bytes` bytes, shared evenly by the languages. Rows
    with a null or empty text or a null lang are left out; equal rows are drawn once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size"), "lang", "text")
    common = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit_langs).collect()}
    names = sorted(common)
    if not names:
        return train([], [])
    each = max(1, limit // len(names))
    # hashes are spread evenly, so about four times the rows that are wanted lie below this one
    upto = F.create_map(*[F.lit(x) for name in names for x in (name, min((1 << 63) - 1, (each << 66) // common[name] - (1 << 63)))])
    near = rows.where(F.col("h") <= upto[F.col("lang")]).select("lang", "h", "size").distinct()
    order: dict[str, list] = {name: [] for name in names}
    for r in sorted(near.collect()):
        if len(order[r.lang]) < each:
            order[r.lang].append(r)
    left, chosen = dict.fromkeys(names, limit_bytes // len(names)), set()
    for r in (r for name in names for r in order[name]):
        if r.size <= left[r.lang] and (r.lang, r.h) not in chosen:
            left[r.lang] -= r.size
            chosen.add((r.lang, r.h))
    wanted = docs.sparkSession.createDataFrame(sorted(chosen), "lang string, h long")
    sample = rows.join(F.broadcast(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"]).mapInArrow(_windows, "lang string, h long, start long, bytes binary")
    found = sample.toArrow().sort_by([("lang", "ascending"), ("h", "ascending"), ("start", "ascending")])
    buf = np.frombuffer(b"".join(found.column("bytes").to_pylist()), np.uint8)
    lengths = np.array([len(x) for x in found.column("bytes").to_pylist()], np.int64)
    return train_windows(windows_of(buf, np.cumsum(lengths) - lengths, lengths), found.column("lang").to_pylist(), names)


def predict(docs: DataFrame, model: tuple[list[str], Weights], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as (row struct with all columns, lang_pred, score).

    A null text, or one without a letter, gets `und` and 0.0; so does all when nothing was learned.
    Of languages of equal probability the first by name is taken. A long text is read whole, CHUNK
    windows at a time. Windows are read apart: a state isn't carried from one to the next.
    Rows are judged one by one: repeated rows get equal results and an empty table none. What other
    columns docs has, and what they are called, doesn't matter: they travel inside `row`.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(frees(_predict(shared)), f"row {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
