"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(family | before) * P(class | family, before) * P(word | class).  The FREQUENT most frequent tokens are
classes of their own; other words belong to one of SUFFIXES classes by a hash of their last three bytes; FAMILY classes that
follow each other are a family.  The first two factors are log-linear models of hashed features: the word before, the two
before, and the words two and three before (skips).  They are trained by gradient steps: in each round every task steps
through its share of the training documents from the common weights, and the weights of all tasks are averaged, row by row
in proportion to the tokens that touched the row, in two levels of sums.  P(word | class) is the smoothed share of the
word among the training tokens of its class, the maximum-entropy solution for word identity.

Counts follow the corpus: documents are dealt into groups of a few megabytes, each sends its distinct tokens once, packed by
hash range, and gets their counts in all training documents back in the same order.  Groups and ranges grow with the root
of the input, so that the number of packets grows in proportion to it.  Words are known by 58 bits of hash and six of suffix
class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LARGE, Words, chunked, deal, id_array, landed, mix, planes, ranges, text_bytes, texts, unplanes

#: Classes of frequent tokens and of suffixes, classes of a family, rows of hashed features, features a token (and a bias row
#: at the end).
FREQUENT, SUFFIXES, FAMILY, ROWS, SLOTS = 64, 64, 16, 1 << 13, 4
#: Rounds of training, step size, tokens a step; smoothing of counts.
ROUNDS, RATE, STEP, ALPHA = 3, 0.25, 1 << 15, 0.1
#: Bytes of text in a group and tokens in a hash range on average, both for inputs up to ROOT bytes; rows of weights that
#: travel together.
GROUP_BYTES, RANGE_TOKENS, ROOT, BLOCK = 4 << 20, 4_000_000, 100 << 30, 512
K = FREQUENT + SUFFIXES
FAMILIES = K // FAMILY
WIDTH = FAMILIES + K  # weights of a row: of the families, then of each family's classes
_LOW = np.uint64(63)
END = np.uint64(0x5E0FE2D0F7EC7001) & ~_LOW
_BEFORE = np.uint64(0xB0B0)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words and its end: a number whose low six bits are the suffix class, the text, and the place in it."""
    h = words.hashes(lower=True) & ~_LOW
    suffix = words.spans(np.maximum(words.starts, words.ends - 3), words.ends, lower=True) % np.uint64(SUFFIXES)
    place = np.arange(len(h)) + words.doc
    first = np.concatenate([[0], np.cumsum(words.counts + 1)])
    out = np.full(first[-1], END, np.uint64)
    out[place] = h | suffix
    doc = np.repeat(np.arange(words.n_docs), words.counts + 1)
    return out, doc, np.arange(len(out)) - first[doc]


def _rows(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The feature rows of every token, SLOTS columns."""
    back = []
    for k in (1, 2, 3):
        b = np.full(len(token), _BEFORE + np.uint64(k), np.uint64)
        b[k:] = np.where(at[k:] >= k, token[:-k], b[k:]) if len(token) > k else b[k:]
        back.append(b)
    one, two, three = back
    mixed = (mix(one + np.uint64(1)), mix(two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2)), mix(three * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(3)), mix(one * np.uint64(0xD6E8FEB86659FD93) + two))
    return np.stack([(m >> np.uint64(51)).astype(np.int64) for m in mixed], 1)


def classes(token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Number of the class: the place among the sorted frequent tokens, or FREQUENT plus the suffix class."""
    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
    return np.where(frequent[at] == token, at, FREQUENT + (token & _LOW).astype(np.int64))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    np.clip(z, -60, 60, out=z)  # so that no exponential overflows; a maximum of each row would cost more than all the rest
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _of_family(rows: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Numbers of the pieces of FAMILY weights that hold the classes of each token's family."""
    return rows * FAMILIES + family[:, None]


def parted(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of families, a row a feature, and those of classes, a row a feature and family."""
    return weights[:, :FAMILIES].copy(), weights[:, FAMILIES:].reshape(-1, FAMILY).copy()


def log_factors(first: np.ndarray, second: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of all families, and of the classes of the family that each token's class belongs to."""
    at = _of_family(rows, kind // FAMILY)
    y, z = first[ROWS].repeat(len(rows)).reshape(FAMILIES, -1).T.copy(), second.take(ROWS * FAMILIES + kind // FAMILY, 0)
    for k in range(SLOTS):
        y += first.take(rows[:, k], 0)
        z += second.take(at[:, k], 0)
    return _log_softmax(y), _log_softmax(z)


def log_class(first: np.ndarray, second: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    y, z = log_factors(first, second, rows, kind)
    each = np.arange(len(kind))
    return y[each, kind // FAMILY] + z[each, kind % FAMILY]


class Trainer:
    """Adaptive gradient steps from common weights, and how many tokens touched each row."""

    def __init__(self, weights: np.ndarray):
        self.first, self.second = parted(weights)
        self.squares = [np.ones(x.shape, np.float32) for x in (self.first, self.second)]
        self.touched = np.zeros(len(self.first), np.float32)

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([self.first, self.second.reshape(-1, K)], 1)

    def step(self, rows: np.ndarray, kind: np.ndarray) -> None:
        family, each = kind // FAMILY, np.arange(len(rows))
        errors = [np.exp(x) for x in log_factors(self.first, self.second, rows, kind)]
        for error, right in zip(errors, (family, kind % FAMILY), strict=True):
            error[each, right] -= 1
        at = _of_family(rows, family).astype(np.uint16)  # 16 bits: numpy sorts them by radix
        for k in range(SLOTS):
            self._move(0, rows[:, k].astype(np.uint16), errors[0])
            self._move(1, at[:, k], errors[1])
            self.touched[:ROWS] += np.bincount(rows[:, k], minlength=ROWS)
        self._add(0, np.array([ROWS]), errors[0].sum(0, keepdims=True))
        self._move(1, family.astype(np.uint16), errors[1], ROWS * FAMILIES)
        self.touched[ROWS] += len(rows)

    def _move(self, which: int, at: np.ndarray, error: np.ndarray, base: int = 0) -> None:
        order = np.argsort(at, kind="stable")
        r = at[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        self._add(which, base + r[first].astype(np.int64), np.add.reduceat(error.take(order, 0), first))

    def _add(self, which: int, at: np.ndarray, gradient: np.ndarray) -> None:
        weights, squares = (self.first, self.second)[which], self.squares[which]
        grown = squares.take(at, 0) + gradient * gradient
        squares[at] = grown
        weights[at] = weights.take(at, 0) - RATE * gradient / np.sqrt(grown)


def _train(weights: np.ndarray, frequent: np.ndarray, of_task: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = None, 0
        for b in batches:
            for _, words in chunked(b.column("doc_id"), b.column("text"), LARGE):
                t = t or Trainer(weights)
                token, _, at = tokens(words)
                task ^= int(token[0])
                rows, kind = _rows(token, at), classes(token, frequent)
                for a in range(0, len(token), STEP):
                    t.step(rows[a : a + STEP], kind[a : a + STEP])
        if t:
            gone = t.weights - weights
            for a in range(0, ROWS + 1, BLOCK):
                some, moved = t.touched[a : a + BLOCK], gone[a : a + BLOCK].astype(np.float16)
                yield pa.record_batch([pa.array([a // BLOCK]), pa.array([(task >> 8) % of_task]), pa.array([moved.tobytes()], pa.binary()), pa.array([some.tobytes()], pa.binary())], ["block", "salt", "moved", "touched"])

    return train


def _mean(t: pa.Table) -> pa.Table:
    """The mean of a block's movements, each row weighted by the tokens that touched it."""
    total = count = 0
    for m, c in zip(t.column("moved").to_pylist(), t.column("touched").to_pylist(), strict=True):
        c = np.frombuffer(c, np.float32).astype(np.float64)
        total = total + np.frombuffer(m, np.float16).reshape(-1, WIDTH).astype(np.float64) * c[:, None]
        count = count + c
    mean = (total / np.maximum(count, 1)[:, None]).astype(np.float16)
    return pa.table([t.column("block")[:1], pa.array([0], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([count.astype(np.float32).tobytes()], pa.binary())], ["block", "salt", "moved", "touched"])


def trained(docs: DataFrame, frequent: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all training documents were stepped through once, an equal part of them each round."""
    weights = np.zeros((ROWS + 1, WIDTH), np.float32)
    schema = "block long, salt long, moved binary, touched binary"
    for r in range(rounds):
        part = docs.where(deal(rounds) == r).select("doc_id", "text")
        moved = part.mapInArrow(_train(weights, frequent, 64), schema)
        for keys in (("block", "salt"), ("block",)):
            moved = moved.groupBy(*keys).applyInArrow(_mean, schema)
        for row in moved.select("block", "moved").collect():  # as many as the weights have blocks
            at = row["block"] * BLOCK
            weights[at : at + BLOCK] += np.frombuffer(row["moved"], np.float16).reshape(-1, WIDTH)
    return weights


def _distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """A group's distinct tokens in order, how often training texts have them, and its chunks, each with its tokens' places
    among the distinct ones."""
    chunks, every, weight = [], [], []
    train_of = t.column("train").to_pylist()
    done = 0
    for ids, words in chunked(t.column("doc_id"), t.column("text"), LARGE):
        token, doc, at = tokens(words)
        train = np.array(train_of[done : done + len(ids)], bool)
        done += len(ids)
        chunks.append((ids, train, words.counts, token, doc, at))
        every.append(token)
        weight.append(train[doc])
    known, back = np.unique(np.concatenate(every), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate(weight), minlength=len(known)).astype(np.int64)
    cut = np.cumsum([len(x) for x in every])[:-1]
    return known, counts, [(*c, b) for c, b in zip(chunks, np.split(back, cut), strict=True)]


def _pack(parts: int):
    def pack(t: pa.Table) -> pa.Table:
        known, counts, _ = _distinct(t)
        group = t.column("group")[0].as_py()
        rows = [(p, group, planes(known[a:b]), planes(counts[a:b])) for p, a, b in ranges(known, parts)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "group", "known", "counts"])

    return pack


_TOLD = "part int, group long, counts binary, class int, n long, v long, top array<struct<count: long, token: long>>"


def _tell(t: pa.Table) -> pa.Table:
    """Counts of a hash range for each group, in the group's order; and per suffix class tokens, types and frequent tokens."""
    hs = [unplanes(b) for b in t.column("known").to_pylist()]
    h = np.concatenate(hs)
    known, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([unplanes(b, np.int64) for b in t.column("counts").to_pylist()]), minlength=len(known)).astype(np.int64)
    mine, at, out = total[back], 0, []
    part = t.column("part")[0].as_py()
    for g, x in zip(t.column("group").to_pylist(), hs, strict=True):
        out.append((part, g, planes(mine[at : at + len(x)]), None, None, None, None))
        at += len(x)
    kind = (known & _LOW).astype(np.int64)
    for c in range(SUFFIXES):
        own = total[(kind == c) & (total > 0)]
        out.append((part, None, None, c, int(own.sum()), len(own), None))
    best = np.lexsort((known, -total))[:FREQUENT]
    out.append((part, None, None, None, None, None, [{"count": int(total[i]), "token": int(known[i].view(np.int64))} for i in best if total[i] > 0]))
    pair = pa.list_(pa.struct([("count", pa.int64()), ("token", pa.int64())]))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pair), strict=True)], ["part", "group", "counts", "class", "n", "v", "top"])


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, frequent: np.ndarray, n_class: np.ndarray, v_class: np.ndarray, n: int, v: int):
    parts = parted(weights)

    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        known, _, chunks = _distinct(docs)
        order = np.argsort(told.column("part").to_numpy())
        blobs = told.column("counts").to_pylist()
        counts = np.concatenate([unplanes(blobs[i], np.int64) for i in order])
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for ids, train, n_words, token, doc, at, place in chunks:
            c = counts[place]
            base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
            kind = classes(token, frequent)
            rows = _rows(token, at)
            own = np.concatenate([log_class(*parts, rows[a : a + STEP], kind[a : a + STEP]) for a in range(0, len(token), STEP)])
            within = np.where(kind < FREQUENT, 0.0, np.log10((c + ALPHA) / (n_class[kind] + ALPHA * (v_class[kind] + 1))))
            total = [np.bincount(doc, weights=x, minlength=len(ids)) for x in (c > 0, base, own / np.log(10) + within)]
            for col, x in zip(out, (ids, ~train, n_words + 1, total[0].astype(np.int64), total[1], total[2]), strict=True):
                col.append(x)
        ids, held, n_tokens, n_known, base, own = (np.concatenate(x) for x in out)
        return pa.table([id_array(ids), pa.array(held), pa.array(n_tokens.astype(np.int64)), pa.array(n_known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(own)], [c.split()[0] for c in _OUT.split(", ")])

    return score


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    A null or empty text is its end token alone.  A null id counts as training.  Repeated rows count as often as they stand
    there and are scored alike.  Without any training document the model is uniform over classes and everything is
    unknown.  Other columns are ignored.
    """
    own = texts(docs).withColumn("train", in_training(F.col("doc_id")))
    total = text_bytes(own)
    large = max(1.0, (total / ROOT) ** 0.5)
    groups, parts = int(total / large) // GROUP_BYTES + 1, max(64, int(total / large) // 6 // RANGE_TOKENS + 1)
    dealt = own.withColumn("group", deal(groups))
    told = landed(dealt.groupBy("group").applyInArrow(_pack(parts), "part int, group long, known binary, counts binary").groupBy("part").applyInArrow(_tell, _TOLD), "counts")
    by_class = {r["class"]: (r["n"], r["v"]) for r in told.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    top = [(r["count"], r["token"]) for r in told.where("top is not null").select(F.explode("top").alias("t")).select("t.count", "t.token").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()]
    n_class, v_class = (np.array([0.0] * FREQUENT + [by_class.get(c, (0, 0))[k] for c in range(SUFFIXES)]) for k in (0, 1))
    n, v = int(n_class.sum()), int(v_class.sum())
    frequent = np.sort(np.array([t for _, t in top] or [0], np.int64).view(np.uint64))
    for count, token in top:
        c = FREQUENT + int(np.int64(token).view(np.uint64) & _LOW)
        n_class[c] -= count
        v_class[c] -= 1
    weights = trained(own.where("train"), frequent, rounds)
    counted = told.where("group is not null").select("part", "group", "counts")
    return dealt.groupBy("group").cogroup(counted.groupBy("group")).applyInArrow(_score(weights, frequent, n_class, v_class, n, v), _OUT)
