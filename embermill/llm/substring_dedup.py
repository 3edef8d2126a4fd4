"""Removal of passages that an earlier document already has.

Every window of `size` words gets a Rabin-Karp hash.  Documents are dealt by id into groups of a few megabytes; each group
sends, for every distinct hash, only its smallest document, packed by hash range, so a passage that stands in a third of
all documents costs one entry a group.  Per hash range the smallest document overall is found and each group is told the
hashes that an earlier document elsewhere has.  The group then marks windows, merges them into maximal intervals and
removes those words.  The texts are shuffled once: both uses of the dealt documents read the same exchange.

Two windows count as equal if their 64-bit hashes are; among n windows about n*n / 2**65 unequal pairs do so by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LARGE, NO_ID, Words, chunked, deal, planes, ranges, text_bytes, texts, unplanes

#: Bytes of text in a group of documents, and windows in a hash range, on average, for inputs up to ROOT bytes; beyond, both
#: grow with the root of the input, so that the number of packets grows in proportion to it.
GROUP_BYTES, RANGE_WINDOWS, ROOT = 4 << 20, 2_000_000, 100 << 30
_BLOB = "part int, group long, hashes binary, docs binary"
_TOLD = "group long, hashes binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start: int, end: int>>"


def _windows(ids: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, at = words.windows(size, words.hashes())
    return h, ids[words.doc[at]], at


def _smallest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the smallest id of each."""
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.minimum.reduceat(ids, first) if len(first) else ids


def _pack(size: int, parts: int):
    def pack(t: pa.Table) -> pa.Table:
        group = t.column("group")[0].as_py()
        found = [_smallest(*_windows(ids, words, size)[:2]) for ids, words in chunked(t.column("doc_id"), t.column("text"), LARGE)]
        h, ids = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        rows = [(p, group, planes(h[a:b]), _ids_out(ids[a:b])) for p, a, b in ranges(h, parts)]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "group", "hashes", "docs"])

    return pack


def _ids_out(ids: np.ndarray) -> bytes:
    """The few distinct ids of a group once, then a small number for each hash."""
    known, nth = np.unique(ids, return_inverse=True)
    wide = np.uint16 if len(known) <= 1 << 16 else np.uint32
    return len(known).to_bytes(8, "little") + planes(known) + nth.astype(wide).tobytes()


def _ids_in(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return unplanes(b[8 : 8 + 8 * n], np.int64)[np.frombuffer(b[8 + 8 * n :], np.uint16 if n <= 1 << 16 else np.uint32)]


def _tell(t: pa.Table) -> pa.Table:
    """For each group, the hashes of this range whose smallest document overall precedes the group's own smallest."""
    groups = t.column("group").to_pylist()
    hs = [unplanes(b) for b in t.column("hashes").to_pylist()]
    ids = np.concatenate([_ids_in(b) for b in t.column("docs").to_pylist()])
    h = np.concatenate(hs)
    order = np.argsort(h)
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(h))))
    late, at, out = least < ids, 0, []
    for g, x in zip(groups, hs, strict=True):
        if len(told := x[late[at : at + len(x)]]):
            out.append((g, planes(told)))
        at += len(x)
    return pa.table([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["group", "hashes"])


def _remove(size: int, full: bool):
    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        chunks = [(ids, words, *_windows(ids, words, size)) for ids, words in chunked(docs.column("doc_id"), docs.column("text"), LARGE)] if docs.num_rows else []
        late = _late(np.concatenate([c[2] for c in chunks]), np.concatenate([c[3] for c in chunks]), told) if chunks else None
        cols: list[list] = [[], [], [], [], [], []]
        done = 0
        for ids, words, h, _, at in chunks:
            mine = at[late[done : done + len(h)]]
            done += len(h)
            step = np.zeros(len(words) + 1, np.int64)
            step[mine] += 1
            step[mine + size] -= 1
            gone = np.cumsum(step)[:-1] > 0
            _kept(ids, words, gone, full, cols)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"][: 6 if full else 4]
        return pa.table([pa.array(c, k) for c, k, _ in zip(cols, kinds, names, strict=False)], names)

    return remove


def _late(h: np.ndarray, ids: np.ndarray, told: pa.Table) -> np.ndarray:
    """Which windows of a group stand in an earlier document, of the group or, as it was told, elsewhere."""
    order = np.argsort(h)
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.empty(0, np.int64)
    least = np.minimum.reduceat(ids[order], first) if len(h) else ids
    for b in told.column("hashes").to_pylist():
        least[np.searchsorted(ordered[first], unplanes(b))] = np.iinfo(np.int64).min
    late = np.empty(len(h), bool)
    late[order] = np.repeat(least, np.diff(np.append(first, len(h)))) < ids[order]
    return late


def _kept(ids: np.ndarray, words: Words, gone: np.ndarray, full: bool, cols: list[list]) -> None:
    """Adds a row for each document: counts, digest and, where asked for, the text that stays and the intervals removed."""
    stay = ~gone
    mark = np.zeros(len(words.data) + 2, np.int8)
    mark[words.starts[stay]] += 1
    mark[words.ends[stay] + 1] -= 1
    spaced = words.data.copy()
    spaced[words.ends] = 0x20
    out = spaced[np.cumsum(mark[:-2], dtype=np.int8) > 0]
    length = np.bincount(words.doc[stay], weights=(words.ends - words.starts)[stay] + 1, minlength=words.n_docs).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(length)])
    flat, removed = out.tobytes(), np.bincount(words.doc[gone], minlength=words.n_docs)
    first = np.concatenate([[0], np.cumsum(words.counts)])
    for d, i in enumerate(ids.tolist()):
        kept = flat[bounds[d] : max(bounds[d], bounds[d + 1] - 1)]
        row = [None if i == NO_ID else i, int(words.counts[d]), int(removed[d]), hashlib.sha256(kept).hexdigest()]
        if full:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[first[d] : first[d + 1]].astype(np.int8), [0]])))
            row += [kept.decode(), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]]
        for c, x in zip(cols, row, strict=False):
            c.append(x)


def remove_repeats(docs: DataFrame, size: int = 50, full: bool = True) -> DataFrame:
    """One row for each document: n_words, n_removed, kept_sha256 and, with `full`, kept_text and the removed intervals
    `spans` (word numbers, end exclusive).

    A word goes if a window of `size` words over it also starts in a document with a smaller doc_id; windows are judged on
    the input.  Null and empty texts have no words and keep nothing.  A null doc_id counts as larger than any other.  Rows
    with the same doc_id do not remove each other's words.  Repeats inside one document stay.  Other columns are ignored.
    """
    # a document's row is kept as it is, repeated rows included; only doc_id and text travel
    own = texts(docs)
    total = text_bytes(own)
    large = max(1.0, (total / ROOT) ** 0.5)
    groups, parts = int(total / large) // GROUP_BYTES + 1, max(64, int(total / large) // 6 // RANGE_WINDOWS + 1)
    dealt = own.withColumn("group", deal(groups))
    blobs = dealt.groupBy("group").applyInArrow(_pack(size, parts), _BLOB)
    told = blobs.groupBy("part").applyInArrow(_tell, _TOLD)
    schema = _OUT if full else ", ".join(_OUT.split(", ")[:4])
    return dealt.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(_remove(size, full), schema)
