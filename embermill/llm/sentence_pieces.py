"""SentencePiece encoding and decoding with a given byte-pair model, as a batched Viterbi search in numpy.

Text is cut where no piece can reach across (before runs of the space mark, around line breaks).  Distinct segments advance
together, one character a step.  The hash of every substring that a piece could fill is looked up in a table of pieces and
their beginnings; at each end position a candidate survives if it can follow the token that ends where it begins, and a
vectorised maximum over the survivors' lengths stores the backpointer.

A byte-pair model's segmentation is not the one of highest summed score, but the one its merges produce.  A sequence is that
segmentation exactly if each neighbouring pair is what merging the pair's own text gives, so the last token of every prefix
is the only candidate that can follow the prefix before it: the search is exact, and the maximum has one survivor.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced, texts

MARK = "▁"
_UNKNOWN = "\N{REPLACEMENT CHARACTER}".encode()
#: Segments that a worker remembers, besides those of the texts at hand; slots for pairs of pieces; pairs remembered for segments searched one by
#: one, which those of more than LONG characters are; characters encoded, and segments searched, at a time.
REMEMBERED, SLOTS, PAIRS, LONG, SOME, TOGETHER = 1 << 17, 1 << 20, 1 << 17, 64, 1 << 21, 1 << 13
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_BASE = 0x9E3779B97F4A7C15
_SPREAD = 0x9FB21C651E98DF25
_NEVER = float("inf")
_FREE = (1 << 16) - 1  # a character that is no piece: written as its bytes, goes with every neighbour


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in usual}
        self.number = {self.pieces[i]: i for i in usual}
        special = {i: b"" for i in range(size) if model.is_control(i)} | {i: bytes([b]) for b, i in self.byte.items()} | {model.unk_id(): " ⁇ ".encode()}
        self.raw = [special.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        self.paths: dict[str, tuple | None] = {}
        self.segments: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.slots = np.full(SLOTS, -1, np.int64)  # twice a pair's key, and one more if its pieces go together
        self.bytes = pa.array(self.raw, pa.large_binary())
        whole = {self.key(self.pieces[i]): i for i in usual if self.path(self.pieces[i])}
        self.longest = max(len(self.pieces[i]) for i in whole.values())
        begun = {self.key(self.pieces[i][:n]): -1 for i in whole.values() for n in range(1, len(self.pieces[i]))} | whole
        bits = (4 * len(begun)).bit_length()
        self.shift, self.keys, self.ids = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
        for h, i in begun.items():
            at = (h * _SPREAD & ((1 << 64) - 1)) >> (64 - bits)
            while self.ids[at] != -2:
                at = (at + 1) % (1 << bits)
            self.keys[at], self.ids[at] = h, i

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def path(self, piece: str) -> tuple | None:
        """The merges that build a piece, each with its rank and the first and last symbol after it; None if the merges of
        its text don't end in the piece."""
        if piece in self.paths:
            return self.paths[piece]
        parts, steps = list(piece), [(-1.0, piece[0], piece[-1])]
        while len(parts) > 1:
            rank, at = min((self.rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((rank, parts[0], parts[-1]))
        self.paths[piece] = found = tuple([*steps, (_NEVER, "", "")]) if len(parts) == 1 else None
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces gives just these two: no merge across the border comes first."""
        if left == _FREE or right == _FREE:
            return True
        a, b, i, j = self.path(self.pieces[left]), self.path(self.pieces[right]), 0, 0
        while True:
            next_a, next_b, across = a[i + 1][0], b[j + 1][0], self.rank.get(a[i][2] + b[j][1], _NEVER)
            if across < next_a and across <= next_b:
                return False
            if next_a == next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each key; -1 if pieces only begin so, -2 if none does."""
        at = (h * np.uint64(_SPREAD) >> self.shift).astype(np.int64)
        ids = self.ids[at]
        other = np.flatnonzero((ids != -2) & (self.keys[at] != h))
        while len(other):
            at[other] = (at[other] + 1) % len(self.ids)
            ids[other] = self.ids[at[other]]
            other = other[(ids[other] != -2) & (self.keys[at[other]] != h[other])]
        return ids

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`follows` of each pair.  A slot holds the last pair that fell into it."""
        keys = (left << 16) | right
        got = self.slots[self.slot(keys)]
        if len(lost := np.flatnonzero(got >> 1 != keys)):
            new, back = np.unique(keys[lost], return_inverse=True)
            fresh = np.fromiter((k << 1 | self.follows(k >> 16, k & _FREE) for k in new.tolist()), np.int64, len(new))
            self.slots[self.slot(new)] = fresh
            got[lost] = fresh[back]
        return (got & 1).astype(bool)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_SPREAD) >> np.uint64(32)) % np.uint64(len(self.slots))).astype(np.int64)

    def search(self, segments: list[str]) -> list[bytes]:
        """Viterbi over segments, whose characters lie end to end in one array."""
        n = len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, n)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        step, room = at - np.repeat(starts, sizes), np.repeat(stops, sizes) - at
        last, back = np.full(len(codes), _FREE, np.int64), np.ones(len(codes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, self.longest + 1):
            at, h = at[go := room[at] >= k], h[go]
            h = h * np.uint64(_BASE) + codes[at + (k - 1)]
            ids = self.find(h)
            fits = ids >= 0
            if k == 1:  # stands where nothing longer fits
                last[at[fits]] = ids[fits]
            else:
                found.append((at[fits] + (k - 1), ids[fits].astype(np.int64), np.full(np.count_nonzero(fits), k)))
            at, h = at[go := ids != -2], h[go]
        end, ids, size = map(np.concatenate, zip(*found, strict=True))
        first = step[end] + 1 == size  # a piece from the begin on has nothing to follow, and no other ends there
        last[end[first]], back[end[first]] = ids[first], size[first]
        taken = np.zeros(len(codes), bool)
        taken[end[first]] = True
        rest = np.flatnonzero(~taken[end])
        rest = rest[np.argsort(step[end[rest]].astype(np.uint16), kind="stable")]
        end, ids, size = end[rest], ids[rest], size[rest]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(step[end]))]).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e, i, k = end[a:b], ids[a:b], size[a:b]
            ok = self.compatible(last[e - k], i)
            e, i, k = e[ok], i[ok], k[ok]
            np.maximum.at(back, e, k)
            best = back[e] == k
            last[e[best]] = i[best]
        row, at, counts, trail = np.arange(n), stops - 1, np.zeros(n, np.int64), []
        while len(row):
            counts[row] += 1
            trail.append((row, last[at]))
            at = at - back[at]
            row, at = row[go := at >= starts[row]], at[go]
        ends, free = np.cumsum(counts), np.zeros(n, bool)
        out = np.empty(ends[-1], np.int32)
        for k, (row, token) in enumerate(trail, 1):
            out[ends[row] - k] = token
            free[row[token == _FREE]] = True
        packed, ends = out.tobytes(), (4 * ends).tolist()
        done = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for r in np.flatnonzero(free).tolist():
            done[r] = self.written(segments[r], np.frombuffer(done[r], np.int32).tolist())
        return done

    def written(self, segment: str, tokens: list[int]) -> bytes:
        """Tokens as identifiers; a character that is no piece is written as its bytes."""
        ids: list[int] = []
        at = 0
        for t in tokens:
            ids += [t] if t != _FREE else [self.byte[b] for b in segment[at].encode()]
            at += len(self.pieces[t]) if t != _FREE else 1
        return np.array(ids, np.int32).tobytes()

    def search_one(self, segment: str) -> bytes:
        """The same search for one segment."""
        last, back, number, pairs = [_FREE], [0], self.number, self.pairs
        for end in range(1, len(segment) + 1):
            token, best = _FREE, 1
            for k in range(min(end, self.longest), 0, -1):
                i = number.get(segment[end - k : end])
                if i is None or self.paths[self.pieces[i]] is None:
                    continue
                ok = end == k or pairs.get(key := (last[end - k] << 16) | i)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.follows(last[end - k], i)
                if ok:
                    token, best = i, k
                    break
            last.append(token)
            back.append(best)
        tokens, at = [], len(segment)
        while at:
            tokens.append(last[at])
            at -= back[at]
        return self.written(segment, tokens[::-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as packed 32-bit numbers."""
        cut = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*cut)
        if len(self.segments) > REMEMBERED:  # the frequent ones are among those at hand
            self.segments = {s: self.segments[s] for s in distinct if s in self.segments}
        known = self.segments
        new = sorted(distinct.difference(known), key=len)
        border = bisect_right(new, LONG, key=len)
        short, alone = new[:border], new[border:]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            known.update(zip(part, self.search(part), strict=True))
        known.update((s, self.search_one(s)) for s in alone)
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for s in alone:
            del known[s]
        return out

    def decode(self, ids: list[int | None]) -> str:
        raw = self.raw
        return self.read(b"".join(raw[i] if i is not None and 0 <= i < len(raw) else _UNKNOWN for i in ids))

    @staticmethod
    def read(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
        """`decode` of many texts' own identifiers, laid end to end."""
        laid = self.bytes.take(pa.array(ids))
        at = np.frombuffer(laid.buffers()[1], np.int64)[offsets].tolist() if len(ids) else [0] * len(offsets)
        data = laid.buffers()[2]
        yield from (self.read(data[a:b].to_pybytes() if a < b else b"") for a, b in zip(at[:-1], at[1:], strict=True))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _some(b: pa.RecordBatch) -> Iterator[list[str]]:
    """Texts of a batch, about SOME characters at a time."""
    held: list[str] = []
    n = 0
    for t in (t for part in sliced(b.column("text")) for t in part.to_pylist()):
        held.append(t)
        n += len(t)
        if n >= SOME:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids (array of the model's identifiers) and round_trip (decoding gives the text back) of every row.

    Identifiers are those of the model's own library.  Null and empty texts have none and round-trip.  A space mark (U+2581)
    in a text is read as a space and so does not round-trip.  Repeated rows and null ids come out as they came in; other
    columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            at = 0
            for some in _some(b):
                packed = own.encode(some)
                ids = [np.frombuffer(p, np.int32) for p in packed]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                ok = [d == t for d, t in zip(own.decode_all(flat, offsets), some, strict=True)]
                yield pa.record_batch([b.column("doc_id").slice(at, len(some)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(ok, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])
                at += len(some)

    return texts(docs).mapInArrow(lean(encode), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text that `ids` stand for: pieces end to end, byte pieces as bytes (malformed ones as U+FFFD), space
    marks as spaces, one leading space dropped.  An identifier that is null or that the model does not have is U+FFFD.  Null
    or empty ids give an empty text.  Repeated rows and null doc_ids come out as they came in; other columns are ignored."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([own.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(decode), "doc_id long, text string")
