"""Token counts of whole texts under a byte-pair vocabulary with word ends, without producing identifiers.

A piece of text starts as one symbol a byte, in a linked list.  A heap holds the adjacent pairs that have a merge rank;
the lowest (leftmost of equals) is popped and merged until none is left.  The count is the initial symbols minus the
merges, so a piece of n bytes takes O(n log n) steps however long it is.  Counts of words that came before are looked up;
that memory is bounded and only saves time.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

#: Words whose counts a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 1 << 19, 64
#: Fixed value: White_Space as the vocabulary's normaliser sees it; str.split() also breaks at U+001C to U+001F.
_WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as the vocabulary's own library does by default: special strings inside a text are one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.first = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + self.end] for c in byte_symbols()]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        specials = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(specials)) if specials else None
        self.mark = next((t["content"][:2] for t in spec["added_tokens"]), None)
        self.words: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of one piece: the heap of ranked pairs over a linked list of symbols."""
        raw = piece.encode()
        n = len(raw)
        symbol = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of = self.merge.get
        heap = [(found[0], i, symbol[i], symbol[i + 1], found[1]) for i in range(n - 1) if (found := rank_of((symbol[i], symbol[i + 1])))]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, joined = heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = joined, -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := rank_of((joined, symbol[k])):
                    heappush(heap, (found[0], i, joined, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := rank_of((symbol[h], joined))):
                heappush(heap, (found[0], h, symbol[h], joined, found[1]))
        return n - merges

    def plain(self, word: str) -> int:
        known, total = self.known, 0
        for p in self.pieces(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()):
            count = known.get(p)
            if count is None:
                count = self.piece(p)
                if len(p) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = count
            total += count
        return total

    def word(self, word: str) -> int:
        if self.special and self.mark in word and (found := self.special.findall(word)):
            count = len(found) + sum(self.plain(x) for x in self.special.split(word) if x)
        else:
            count = self.plain(word)
        if len(word) <= LONGEST:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[word] = count
        return count

    def text(self, text: str) -> int:
        words = _WHITE.split(text) if _ODD.search(text) else text.split()
        get, total = self.words.get, 0
        for w in words:
            count = get(w)
            total += self.word(w) if count is None and w else count or 0
        return total


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts have no bytes and no tokens.  Repeated rows and ids, null ids included, come out as they came in;
    other columns are ignored; an empty table gives an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary).text
        for b in batches:
            tokens = [of(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
