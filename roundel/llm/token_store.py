"""Content-addressed store of token ids.

Each document's ids, with the end id, are one stream. A rolling hash over 16 ids cuts it into chunks,
so equal passages give equal chunks wherever they stand. A chunk's address is a hash of its ids. The
chunk is stored once, inside the row of the first document that has it; every document's row is its
recipe, the list of addresses. Format of a store:

    packs/     doc_id, part, row, n_tokens, leaf, keys, ends, kept, shared [(key, ids)], missing, ascending by doc_id
    parts/     part, rows and ids before it
    manifest/  node, hash: each over FANOUT leaves in document order, and so on up to the root

`leaf` is the SHA-256 of a document's ids as little-endian unsigned 32-bit integers. `ids` holds 2 or 4
bytes an id, as the vocabulary needs. `kept` has the chunks that no other document names, one behind the
other, `shared` those that others name too, `missing` the addresses that an earlier document has; only
those are looked up when the store is read, so unique text never moves. `ends` says where chunks end.

Texts are encoded where they are. Only addresses are shuffled to find the first owner of each chunk;
ids are dealt out once, by ranges of doc_id.
"""

from __future__ import annotations

import gc
import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frees, read, shared_dir, slices, stored
from .words import BASE, SPACE, mixed, powers

END_ID = 1
WINDOW, MIN_CHUNK, MASK, MAX_CHUNK = 16, 64, 255, 1024  # ids; WINDOW is a power of two
FANOUT = 1024
CACHE_WORDS = 600_000
#: Fixed value: how the tokenizer cuts a text, and the same for Python.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = regex.compile(PATTERN)
#: The tokenizer shows bytes as characters: printable Latin-1 as it is, the others from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
PACKS = "doc_id long, part int, row long, before long, n_tokens long, leaf binary, keys array<binary>, ends array<long>, kept binary, shared array<struct<key:binary,ids:binary>>, missing array<binary>"


class WordEncoder(dict):
    """Ids of texts, word by word, in `width` bytes an id.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in
    order, and each distinct word is encoded once. Words of a text within Latin-1 are lower-cased and cut
    up as the tokenizer's pattern does, and the library's model encodes each distinct part; the library
    encodes any other word as a whole. Words are split at ASCII white space only. A text that names an
    added token, such as <|endoftext|>, is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.end = END_ID.to_bytes(self.width, "little")
        self.others: dict[bytes, bytes] = {}
        self.plain = self._as_expected()
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _as_expected(self) -> bool:
        """Whether words may be cut up here: lower-cased, with the known pattern, and bytes as characters."""
        set_up = json.loads(self.tokenizer.to_str())
        steps = (set_up["normalizer"] or {}).get("normalizers", [])
        pre = (set_up["pre_tokenizer"] or {}).get("pretokenizers", [])
        return [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": PATTERN} and pre[0]["behavior"] == "Removed"

    def _packed(self, ids: list[int]) -> bytes:
        found = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(SHOWN)
        return self._packed([t.id for t in self.model.tokenize(shown)])

    def __missing__(self, word: bytes) -> bytes:
        """A lower-cased word, or a part of one, in Latin-1."""
        low = word.decode("latin-1")
        if low.isalpha():  # one run of letters
            found = self._part(low)
        elif low.isprintable():
            parts = CUT.findall(low)
            found = self._part(low) if parts == [low] else b"".join([self[p.encode("latin-1")] for p in parts])
        else:
            found = self.whole(low)
        self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def names_added(self, low: str) -> bool:
        """Whether a lower-cased text may hold an added token, which the library finds before it cuts words."""
        return any(x in low for x in self.added)

    def other(self, word: bytes) -> bytes:
        """A word of a text with characters beyond Latin-1."""
        found = self.others.get(word)
        if found is None:
            found = self.others[word] = self.whole(word.decode("utf-8", "replace"))
        return found

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text and the end id."""
        text = text or ""
        if len(self) + len(self.others) > CACHE_WORDS:
            self.clear()
            self.others.clear()
        low = text.lower()
        if self.names_added(low):
            return self.whole(text) + self.end
        try:
            if not self.plain:
                raise UnicodeError
            words, of = low.encode("latin-1").split(), self.__getitem__
        except UnicodeError:
            words, of = text.encode("utf-8", "replace").split(), self.other
        return b"".join([*map(of, words), self.end])


    def all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id.

        Texts within Latin-1 go together: equal words of up to 16 bytes are found by their bytes as two
        integers, each distinct one is looked up once, and ids are gathered from what was found. Stops
        behind letters are words of their own. Texts with other characters or U+0000 are encoded one at a time.
        """
        if len(self) + len(self.others) > CACHE_WORDS:
            self.clear()
            self.others.clear()
        out: list[bytes] = [b""] * len(texts)
        plain, at = [], []
        for i, text in enumerate(texts):
            low = (text or "").lower()
            try:
                data = low.encode("latin-1")
            except UnicodeError:
                data = b"\0"
            if self.plain and b"\0" not in data and not self.names_added(low):
                plain.append(data)
                at.append(i)
            else:
                out[i] = self(text)
        if not plain:
            return out
        data = b"\n".join([*plain, b""])
        buf = np.frombuffer(data, np.uint8)
        inside = ~SPACE[buf]  # each text has a line feed behind it
        before, cut = np.zeros_like(inside), np.zeros_like(inside)
        before[1:] = inside[:-1]
        cut[1:] = LETTER[buf[:-1]] & STOP[buf[1:]]  # no part of a word has a letter and a stop behind it
        starts, ends = np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))
        code, first = _same_words(data, starts, ends)
        found = [self[data[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found.append(self.end)
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        flat, begin = np.frombuffer(b"".join(found), f"<u{self.width}"), np.cumsum(n_ids) - n_ids
        words = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in plain]))  # up to the end of each text
        which = np.full(len(code) + len(plain), len(found) - 1)
        which[np.arange(len(code)) + np.repeat(np.arange(len(plain)), np.diff(words, prepend=0))] = code
        n = n_ids[which]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[which] - stop + n, n) + np.arange(stop[-1])].tobytes()
        bounds = (stop[words + np.arange(len(plain))] * self.width).tolist()
        for i, a, b in zip(at, [0, *bounds], bounds, strict=False):
            out[i] = ids[a:b]
        return out


LETTER = np.array([chr(b).isalpha() for b in range(256)])
STOP = np.isin(np.arange(256), list(b".,;:!?"))
#: Keeps the first 0 to 8 bytes of a little-endian integer.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _same_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word and, by number, a word that has it; equal numbers mean equal words. No word holds U+0000.

    Words of over 16 bytes, and any whose hash another word has, get numbers of their own.
    """
    size = ends - starts
    eight = np.ndarray(len(data) + 9, "<u8", data + bytes(16), strides=1)
    low = eight[starts] & FIRST_BYTES[np.minimum(size, 8)]
    high = eight[starts + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
    hashed = pa.array(mixed(low) ^ high * BASE).dictionary_encode()
    code = hashed.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(hashed.dictionary), np.int64)
    first[code] = np.arange(len(code))
    like = first[code]
    alone = np.flatnonzero((size > 16) | (low != low[like]) | (high != high[like]) | (size[like] > 16))
    code[alone] = len(first) + np.arange(len(alone))
    return code, np.concatenate([first, alone])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Behind which ids the rolling hash of the WINDOW ids before asks for a cut."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = mixed((ids.astype(np.uint64) + np.uint64(1)) * BASE)
    up = powers(WINDOW)
    total, k = value, 1
    while k < WINDOW:  # sums over 2, 4, 8, 16 ids
        total = total[: len(total) - k] + total[k:] * up[k]
        k *= 2
    return np.flatnonzero((mixed(total) & np.uint64(MASK)) == 0) + WINDOW


def chunk_ends(places: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from begin to end; chunks have MIN_CHUNK to MAX_CHUNK ids, the last may be shorter.

    MIN_CHUNK exceeds WINDOW, so no cut depends on ids before the stream.
    """
    ends = []
    for c in [*places, end]:
        while c - begin > MAX_CHUNK:
            begin += MAX_CHUNK
            ends.append(begin)
        if c == end and begin < end or c - begin >= MIN_CHUNK:
            begin = c
            ends.append(c)
    return ends


def _encode(path: str) -> Callable:
    """Ids of every text, and the address and end of each of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        gc.disable()  # what is made here has no cycles, and scans of the cache cost more than they find
        try:
            for batch in slices(batches, "text"):
                streams = encode.all(batch.column("text").to_pylist())
                ids = np.frombuffer(b"".join(streams), f"<u{encode.width}")
                bounds = np.concatenate([[0], np.cumsum([len(s) // encode.width for s in streams])])
                places, wide = cut_places(ids), ids.astype("<u4")
                at = np.searchsorted(places, bounds)
                keys, ends = [], []
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    stops = chunk_ends(places[at[i] : at[i + 1]].tolist(), a, b)
                    keys.append([blake2b(wide[x:y], digest_size=16).digest() for x, y in zip([a, *stops], stops, strict=False)])
                    ends.append([x - a for x in stops])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(streams, pa.binary()), pa.array(keys, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "ids", "keys", "ends"])
        finally:  # the worker is used again, also after a failed task
            encode.clear()
            encode.others.clear()
            gc.enable()

    return run


def _pack(width: int) -> Callable:
    """Rows of packs from streams in order; the addresses that a document owns stand in a row just before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, 0
        of, alone, common = object(), set(), set()
        for batch in slices(batches, "ids"):
            out = []
            for doc, ids, keys, ends, own, own_shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "keys", "ends", "own", "own_shared")), strict=True):
                if own is not None:
                    of, alone, common = doc, set(own), set(own_shared)
                    continue
                kept, shared, missing = ids, [], []
                if doc == of and len(alone) >= len(keys) and len(distinct := {*keys}) == len(keys) and distinct <= alone:  # every chunk is this row's alone
                    alone -= distinct
                else:
                    mine, seen = [], set()
                    for key, x, y in zip(keys, [0, *ends], ends, strict=False):
                        if doc == of and key in alone:
                            alone.discard(key)
                            mine.append(ids[x * width : y * width])
                        elif doc == of and key in common:
                            common.discard(key)
                            shared.append({"key": key, "ids": ids[x * width : y * width]})
                        elif key not in seen:
                            missing.append(key)
                        seen.add(key)
                    kept = b"".join(mine)
                n = len(ids) // width
                leaf = sha256(np.frombuffer(ids, f"<u{width}").astype("<u4")).digest()
                out.append((doc, part, row, before, n, leaf, keys, ends, kept, shared, missing))
                row, before = row + 1, before + n
            if out:
                names = ("doc_id", "part", "row", "before", "n_tokens", "leaf", "keys", "ends", "kept", "shared", "missing")
                kind = pa.list_(pa.struct([("key", pa.binary()), ("ids", pa.binary())]))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), kind, pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*names])

    return run


def rebuilt_stream(keys: list[bytes], ends: list[int], kept: bytes, shared: list[dict], other: list[dict] | None, width: int) -> bytes:
    """A document's ids from its recipe."""
    have = {x["key"]: x["ids"] for x in (*shared, *(other or ()))}
    out, at = [], 0
    for key, x, y in zip(keys, [0, *ends], ends, strict=False):
        ids = have.get(key)
        if ids is None:
            ids = have[key] = kept[at : at + (y - x) * width]
            at += len(ids)
        out.append(ids)
    return b"".join(out)


def _rebuild(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, leaves, sizes = [], [], []
            whole = "keys" not in batch.schema.names
            for row in batch.column("kept").to_pylist() if whole else zip(*(batch.column(c).to_pylist() for c in ("keys", "ends", "kept", "shared", "other")), strict=True):
                ids = np.frombuffer(row if whole else rebuilt_stream(*row, width), f"<u{width}").astype("<u4")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids))
                leaves.append(sha256(ids).digest())
            if crcs:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "row", "before")), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(leaves, pa.binary())], names=["doc_id", "part", "row", "before", "n_tokens", "ids_crc32", "leaf"])

    return run


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """(node, hash) over FANOUT leaves each, from (at, leaf); a level for each further power of FANOUT, up to one root."""
    level, out, depth = leaves.select("at", F.hex("leaf").alias("hash")), None, 0
    while True:
        depth += 1
        up = level.groupBy(F.floor(F.col("at") / FANOUT).alias("at")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))
        level = stored(up, "merkle")
        nodes = level.select(F.lit(depth).alias("level"), F.col("at").alias("node"), "hash")
        out = nodes if out is None else out.union(nodes)
        if level.count() <= 1:
            return out


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write a store below path.

    A null text is an empty one: its stream is the end id alone. Repeated rows are documents of their
    own that name the same chunks. Null ids come first. An empty table gives an empty store.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    streams = stored(docs.mapInArrow(frees(_encode(tokenizer)), "doc_id long, ids binary, keys array<binary>, ends array<long>"), "streams", compression="zstd")
    named = streams.select("doc_id", F.monotonically_increasing_id().alias("at"), "keys").select("doc_id", "at", F.explode("keys").alias("key"))  # at tells rows of one doc_id apart
    first = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.min("at") != F.max("at")).alias("shared"))
    key = F.when(~F.col("shared"), F.col("key"))
    owned = stored(first.groupBy("doc_id").agg(F.collect_list(key).alias("own"), F.collect_list(F.when(F.col("shared"), F.col("key"))).alias("own_shared")), "owned")
    both = streams.withColumns({c: F.lit(None).cast("array<binary>") for c in ("own", "own_shared")}).unionByName(owned, allowMissingColumns=True)
    ordered = both.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("own").isNull())
    ordered.mapInArrow(frees(_pack(encoder(tokenizer).width)), PACKS).write.option("compression", "zstd").parquet(f"{path}/packs")
    spark = docs.sparkSession
    packs = spark.read.parquet(f"{path}/packs")
    sums = packs.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    sums.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids_before")).write.parquet(f"{path}/parts")
    leaves = _placed(packs.select("part", "row", "leaf"), spark.read.parquet(f"{path}/parts"))
    merkle_nodes(leaves).write.parquet(f"{path}/manifest")


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with their number in the whole store; parts has a row for each written partition, as many as the range exchange made."""
    return rows.join(F.broadcast(parts), "part").withColumn("at", F.col("rows_before") + F.col("row"))


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Every document rebuilt from its recipe: doc_id, part, row, before, n_tokens, ids_crc32, leaf."""
    packs = spark.read.parquet(f"{path}/packs")
    schema = "doc_id long, part int, row long, before long, n_tokens long, ids_crc32 long, leaf binary"
    columns = ["doc_id", "part", "row", "before", "keys", "ends", "kept", "shared"]
    plain = (F.size("missing") == 0) & (F.size("shared") == 0) & (F.length("kept") == width * F.col("n_tokens"))
    alone = packs.where(plain).select("doc_id", "part", "row", "before", "kept")
    wanted = packs.select("part", "row", F.explode("missing").alias("key"))
    known = packs.select(F.explode("shared").alias("x")).select("x.key", "x.ids")
    other = wanted.join(known, "key").groupBy("part", "row").agg(F.collect_list(F.struct("key", "ids")).alias("other"))
    rest = packs.where(~plain).select(*columns).join(other, ["part", "row"], "left").select(*columns, "other")
    return alone.mapInArrow(_rebuild(width), schema).unionByName(rest.mapInArrow(_rebuild(width), schema))


def round_trip(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store, read it back and verify it: doc_id, start, n_tokens, ids_crc32. Raises if the manifest disagrees."""
    spark = docs.sparkSession
    write_store(docs, path, tokenizer, id_col, text_col)
    rebuilt = stored(_placed(read_store(spark, path, encoder(tokenizer).width), spark.read.parquet(f"{path}/parts")), "rebuilt")
    again, manifest = merkle_nodes(rebuilt.select("at", "leaf")), spark.read.parquet(f"{path}/manifest")
    if not again.exceptAll(manifest).isEmpty() or not manifest.exceptAll(again).isEmpty():
        raise RuntimeError(f"{path}: what the store gives back differs from its manifest")
    return rebuilt.select("doc_id", (F.col("ids_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), shared_dir(spark, "token-store"), public_tokenizers.path("word_bpe_49k.json"))
