"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units no piece can cross: spaces with the word behind them, and
single characters that stand in no longer piece. The distinct units are one string, with breaks
between them, and a suffix array over it (prefix doubling up to the longest piece) is searched for
every piece at once by binary search. Each occurrence is an edge from its first character to its end;
edges are sorted by where they end in their unit, and relaxed in that order, all units at once; a unit
of more than LONG_UNIT characters is relaxed by itself, SEGMENT characters at a time.

The model merges pairs by rank, so an edge is not taken for its score. The encoding of a prefix ends
in exactly one piece: the one that, with the last piece of the prefix before it, stays as it is when
both are encoded together. Relaxation keeps that edge. Whether two pieces stay apart follows from the
last merges inside each of them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, read, slices
from .words import BASE

SPACE = "▁"
CACHE_UNITS = 250_000
INDEX_CHARS = 400_000  # of distinct units that one suffix array covers
BATCH_BYTES = 2_000_000
LONG_UNIT, SEGMENT, KNOWN_PAIRS = 4096, 200_000, 1_000_000
NONE = np.int64(1 << 40)


class PieceModel:
    """Pieces, byte pieces and merges of a byte-fallback BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.id = {names[i]: i for i in plain}
        if any(SPACE in name.lstrip(SPACE) for name in self.id):
            raise ValueError("a piece holds a space behind another character, so words can't be cut apart")
        self.out = [b""] * n  # what each id decodes to
        for i in plain:
            self.out[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        self.unknown = model.unk_id()
        self.out[self.unknown] = " ⁇ ".encode()
        inside = {c for name in self.id if len(name) > 1 for c in name}
        # units: a run of characters that pieces join, with the spaces before it, or one other character
        self.whole = bool(re.search(r"\s", "".join(inside)))
        joined = "".join(map(re.escape, sorted(inside - {SPACE})))
        self.unit = re.compile(f"{SPACE}+[{joined}]*|[{joined}]+|[^{SPACE}{joined}]")
        self._merges({i: model.get_score(i) for i in plain})

    def _merges(self, score: dict[int, float]) -> None:
        """The last merge inside each piece, found by encoding its characters; what no encoding gives is left out."""
        order = sorted(score, key=lambda i: (-score[i], i))
        self.rank = np.full(len(self.out), NONE)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(len(self.out), -1), np.full(len(self.out), -1)
        name = {i: s for s, i in self.id.items()}
        good, pairs = [], []
        for i in order:
            if len(name[i]) == 1:
                good.append(i)
                continue
            parts = self.merge_all(name[i], stop=2)
            if len(parts) == 2 and all(p in self.id for p in parts):
                self.left[i], self.right[i] = self.id[parts[0]], self.id[parts[1]]
                good.append(i)
            for k in range(1, len(name[i])):
                a, b = self.id.get(name[i][:k]), self.id.get(name[i][k:])
                if a is not None and b is not None:
                    pairs.append((a << 20 | b, self.rank[i]))
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.may_join = np.zeros(1 << 22, bool)
        self.may_join[self._cell(self.pair)] = True
        self.good = sorted((name[i], i) for i in good)
        self.longest = max(len(s) for s, _ in self.good)
        self.chars = np.full((len(self.good), self.longest), -1, np.int64)
        for row, (s, _) in zip(self.chars, self.good, strict=True):
            row[: len(s)] = [*map(ord, s)]
        three = np.full((len(self.good), 3), -1, np.int64)
        three[:, : min(3, self.longest)] = self.chars[:, :3]
        low, high = np.where(three < 0, 0, three), np.where(three < 0, 0x1FFFFF, three)
        self.first_low, self.first_high = (x[:, 0] << 42 | x[:, 1] << 21 | x[:, 2] for x in (low, high))
        self.char_pairs = self._cell(self.chars[:, :-1] << 21 | np.maximum(self.chars[:, 1:], 0))
        self.length = np.array([len(s) for s, _ in self.good])
        self.good_id = np.array([i for _, i in self.good])
        self._plain: tuple | None = None

    def merge_all(self, text: str, stop: int = 1) -> list[str]:
        """The plain definition: merge the pair of the best rank, leftmost first, until none or `stop` parts are left."""
        parts = list(text)
        while len(parts) > stop:
            ranked = [(self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair would merge into."""
        key = a << 20 | b
        out = np.full(len(key), NONE)
        maybe = np.flatnonzero(self.may_join[self._cell(key)])
        at = np.minimum(np.searchsorted(self.pair, key[maybe]), len(self.pair) - 1)
        out[maybe] = np.where(self.pair[at] == key[maybe], self.pair_rank[at], NONE)
        return out

    @staticmethod
    def _cell(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * BASE >> np.uint64(42)).astype(np.int64)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding both pieces together gives these two pieces again.

        Undo their merges from the last to the first; at each moment the pair that met at the border
        must not have been able to merge before what came next.
        """
        n = len(a)
        ok = np.ones(n, bool)
        live = np.arange(n)
        a, b, limit = a.copy(), b.copy(), np.full(n, NONE)
        while len(live):
            bad = self.joint(a, b) < limit
            ok[live[bad]] = False
            ra = np.where(self.right[a] >= 0, self.rank[a], -1)
            rb = np.where(self.right[b] >= 0, self.rank[b], -1)
            keep = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, limit, ra, rb = live[keep], a[keep], b[keep], limit[keep], ra[keep], rb[keep]
            first = ra > rb  # undo the merge that came last; of equal ranks the right one did
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of all pieces: first character, end, piece; and where each unit begins."""
        text = "\0".join(units) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(u) for u in units])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        codes[begins[1:] - 1] = 0x110000  # a break is no character
        n = len(codes)
        _, rank = np.unique(codes, return_inverse=True)
        k = 1
        while k < self.longest:
            key = rank.astype(np.int64) * (n + 1)
            key[: n - k] += rank[k:] + 1
            _, rank = np.unique(key, return_inverse=True)
            k *= 2
        array = np.argsort(rank, kind="stable").astype(np.int32)
        padded = np.concatenate([codes, np.full(self.longest + 3, 0x110001)])
        which = self._possible(codes)
        first = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2 : n + 2]  # three characters in one number, in order
        first = first[array]
        low, high = np.searchsorted(first, self.first_low[which], "left"), np.searchsorted(first, self.first_high[which], "right")
        long = np.flatnonzero(self.length[which] > 3)
        a, b = low[long], high[long]
        low[long], high[long] = self._bound(array, padded, which[long], a, b, False), self._bound(array, padded, which[long], a, b, True)
        count = high - low
        piece = np.repeat(which, count)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        start = array[at]
        return start, start + self.length[piece], self.good_id[piece], begins

    def _possible(self, codes: np.ndarray) -> np.ndarray:
        """Pieces whose characters, and pairs of characters, all occur in the text (pairs by a hash)."""
        chars = np.zeros(0x110001, bool)
        chars[codes] = True
        ok = (chars[np.maximum(self.chars, 0)] | (self.chars < 0)).all(axis=1)
        pairs = np.zeros(1 << 22, bool)
        pairs[self._cell(codes[:-1] << 21 | codes[1:])] = True
        return np.flatnonzero(ok & (pairs[self.char_pairs] | (self.chars[:, 1:] < 0)).all(axis=1)).astype(np.int32)

    def _bound(self, array: np.ndarray, padded: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """From low to high, the first suffix not before each of the pieces, or behind all that begin with it."""
        low, high = low.copy(), high.copy()
        wide = np.arange(self.longest)
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            chars = self.chars[which[todo]]
            differ = np.where(chars < 0, 0, padded[array[mid][:, None] + wide] - chars)
            sign = differ[np.arange(len(todo)), (differ != 0).argmax(axis=1)]
            right = sign <= 0 if after else sign < 0
            low[todo] = np.where(right, mid + 1, low[todo])
            high[todo] = np.where(right, high[todo], mid)
        return low

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        start, end, piece, begins = self.edges(units)
        n = int(begins[-1])
        origin = np.repeat(begins[:-1], np.diff(begins))
        step = end - origin[start]
        # by the end within the unit, then by unit; of edges to one end the longest first
        order = np.argsort((step * (n + 1) + end) * (self.longest + 1) + self.longest - (end - start))
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        last, back = np.full(n + 1, -1), np.full(n + 1, -1)
        firsts = np.zeros(n + 1, bool)
        firsts[begins] = True
        reached = firsts.copy()
        bounds = np.flatnonzero(np.diff(step, prepend=-1)).tolist() + [len(step)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            while len(s):
                top = np.ones(len(s), bool)  # the longest edge to each end that is still open
                top[1:] = e[1:] != e[:-1]
                a, b, c = s[top], e[top], p[top]
                good = reached[a]
                test = np.flatnonzero(good & ~firsts[a])
                good[test] = self.apart(last[a[test]], c[test])
                last[b[good]], back[b[good]], reached[b[good]] = c[good], a[good], True
                rest = ~top & ~reached[e]
                s, e, p = s[rest], e[rest], p[rest]
        return self._paths(units, begins, last, back)

    def encode_long(self, unit: str) -> bytes:
        """Ids of one unit of any length, in time and memory that follow it."""
        n, known = len(unit), {}
        last, back, reached = array("i", [-1]) * (n + 1), array("i", [-1]) * (n + 1), bytearray(n + 1)
        reached[0] = 1
        for a in range(0, n, SEGMENT):
            b, base = min(n, a + SEGMENT), max(0, a - self.longest)
            start, end, piece, _ = self.edges([unit[base:b]])
            start, end = start + base, end + base
            order = np.lexsort((start, end))
            order = order[end[order] > a]
            for s, e, p in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), strict=True):
                if reached[e] or not reached[s]:
                    continue
                if s:
                    pair = last[s] << 20 | p
                    if (good := known.get(pair)) is None:
                        if len(known) > KNOWN_PAIRS:
                            known.clear()
                        good = known[pair] = self._apart_one(last[s], p)
                    if not good:
                        continue
                last[e], back[e], reached[e] = p, s, 1
        ids, at = [], n
        while at:
            if back[at] < 0:
                ids += [self.byte[x] for x in reversed(unit[at - 1].encode("utf-8", "replace"))]
                at -= 1
            else:
                ids.append(last[at])
                at = back[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def _apart_one(self, a: int, b: int) -> bool:
        """`apart` for one pair."""
        if self._plain is None:
            self._plain = dict(zip(self.pair.tolist(), self.pair_rank.tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist()
        pairs, rank, left, right = self._plain
        limit = none = int(NONE)
        while pairs.get(a << 20 | b, none) >= limit:
            ra, rb = rank[a] if right[a] >= 0 else -1, rank[b] if right[b] >= 0 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, right[a]
            else:
                limit, b = rb + 1, left[b]
        return False

    def _paths(self, units: list[str], begins: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """The pieces on the way from each unit's end to its beginning; all units walk at once."""
        first, at = begins[:-1], begins[1:] - 1
        unit = np.flatnonzero(at > first)
        at, steps = at[unit], []
        odd = np.zeros(len(units), bool)  # those with a character that has no piece
        while len(unit):
            odd[unit[back[at] < 0]] = True
            go = ~odd[unit]
            unit, at = unit[go], at[go]
            steps.append((unit, at, last[at]))
            at = back[at]
            go = at > first[unit]
            unit, at = unit[go], at[go]
        where, place, ids = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 3
        use = ~odd[where]
        where, place, ids = where[use], place[use], ids[use]
        data = ids[np.argsort(place)].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(units)))])).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero(odd).tolist():
            at, begin, found = int(begins[i]) + len(units[i]), int(begins[i]), []
            while at > begin:
                if back[at] < 0:  # its bytes instead
                    found += [self.byte[b] for b in reversed(units[i][at - 1 - begin].encode("utf-8", "replace"))]
                    at -= 1
                else:
                    found.append(int(last[at]))
                    at = int(back[at])
            out[i] = np.array(found[::-1], "<u4").tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are joined, and the space that encoding put first goes."""
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class PieceCodec(dict):
    """Encodes texts; keeps the ids of units it has met."""

    def __init__(self, path: str):
        self.model = PieceModel(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.model.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self) > CACHE_UNITS:
            self.clear()
        new = list({u for units in cut for u in units} - self.keys())
        long = [u for u in new if len(u) > LONG_UNIT]
        self.update((u, self.model.encode_long(u)) for u in long)
        if new := [u for u in new if len(u) <= LONG_UNIT] if long else new:
            ends = np.cumsum([len(u) + 1 for u in new])
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(INDEX_CHARS, ends[-1], INDEX_CHARS))).tolist(), len(new)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    self.update(zip(new[a:b], self.model.encode_units(new[a:b]), strict=True))
        out = [np.frombuffer(b"".join(map(self.__getitem__, units)), "<u4") for units in cut]
        for u in long:
            del self[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist())


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = code.encode(texts)
            same = [code.decode(ids) == t.replace(SPACE, " ") for ids, t in zip(rows, texts, strict=True)]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), ids, pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(same)], names=[*batch.schema.names, "ids", "ids_crc32", "round_trip"])
        code.clear()

    return run


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids, ids_crc32, round_trip) for each row of docs.

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers; round_trip says
    whether decoding gives the text again. A null or empty text has no ids. Each row depends on
    itself alone, so repeated rows get equal results and an empty table gives none. Of two pieces that
    could be merged the model's rank decides, of equal ranks the left one. A long text is encoded whole,
    also one without a space. Other columns are ignored, whatever their names. U+2581 in a text is taken for a space, as the model does.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frees(_encode(model)), "doc_id long, text string, ids array<int>, ids_crc32 long, round_trip boolean")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "round_trip")
