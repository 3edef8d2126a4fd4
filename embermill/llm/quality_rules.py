"""Quality rules: fixed limits, then an isolation forest on the statistics of the rules.

Trees split random features at random places until a good row stands alone; rows that end after short paths are unlike the
good documents the trees grew from.  Every tree grows from all good labelled rows: its cuts are drawn over the box of all
labelled rows and hang on no row, tasks count the good rows of each leaf, and the counts tell where paths end.  The score
above which a document is rejected is the one that parts all labelled rows best, a lost good document counting as much as
LOSS missed bad ones; it is searched among all scores, range by range.  Statistics and scores cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, batches, chunked, dropped, id_array, landed, lean, planes, texts, unplanes

#: Trees, levels, and the weight of a lost good document; ranges of scores that are searched apart.
TREES, DEPTH, LOSS, RANGES = 128, 12, 8.0, 4096
#: Limits of the base rules.
MIN_WORDS, MAX_REPEAT_PER_CENT = 50, 50


def _bytes(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_LEAD = (np.arange(256) & 0xC0) != 0x80
_SYMBOLS, _SHOUTS, _BARS, _STOPS, _LINES = (_bytes(x) for x in (b"#*$%&|<>", b"!?", b"|", b".,;:", b"\n"))
_UPPER, _DIGITS, _LETTERS = (_bytes(bytes(x)) for x in (range(65, 91), range(48, 58), [*range(65, 91), *range(97, 123), *range(128, 256)]))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = 10


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another of the same text, and which an earlier one."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else False
    later[order] = np.concatenate([[False], same]) if len(key) else False
    return any_, later


def statistics(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the base rules, a row a text, and the ratios that the forest sees."""
    n, data = words.n_docs, words.data
    chars = np.concatenate([[0], np.cumsum(_LEAD[data])])
    word_chars = np.bincount(words.doc, weights=chars[words.ends] - chars[words.starts], minlength=n).astype(np.int64)
    breaks = np.union1d(np.flatnonzero(data == 0x0A), words.bounds[1:] - 1)
    from_ = np.concatenate([[0], breaks[:-1] + 1])
    # a line that begins in the separator of an empty text holds no word
    held = np.diff(np.searchsorted(words.starts, np.append(from_, len(data)))) > 0
    from_, to = from_[held], breaks[held]
    line_doc = words.doc[np.searchsorted(words.starts, from_)] if len(from_) else np.empty(0, np.int64)
    later = _repeats(words.spans(from_, to), line_doc)[1]
    n_dup = np.bincount(line_doc[later], minlength=n)
    w, at = words.windows(3, words.hashes())
    twice = at[_repeats(w, words.doc[at])[0]]
    step = np.zeros(len(words) + 3, np.int8)
    for k in range(3):
        step[twice + k] = 1
    n_repeat = np.bincount(words.doc[step[: len(words)] > 0], minlength=n)
    n_lines = np.bincount(line_doc, minlength=n)
    n_symbols, shouts, bars, stops = (words.tally(x) for x in (_SYMBOLS, _SHOUTS, _BARS, _STOPS))
    upper, digits, letters = (words.tally(x) for x in (_UPPER, _DIGITS, _LETTERS))
    per_word, per_byte = np.maximum(words.counts, 1), np.maximum(words.sizes, 1)
    counts = np.stack([words.counts, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    ratios = [word_chars / per_word, n_symbols / per_word, n_dup / np.maximum(n_lines, 1), n_repeat / per_word, shouts / per_word, bars / per_word, stops / per_word, upper / np.maximum(letters, 1), digits / per_byte, n_lines / per_word]
    return counts, np.stack(ratios, 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PER_CENT * counts[:, 0])


def _depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees over the box of all labelled rows, grown from good ones: a cut may fall where no good row lies, and what it
    parts off is isolated at once.  Arrays of nodes over all trees: feature (-1: a leaf), cut, path.  Trees are complete; the
    leaves below a node where fewer than two rows are left have the path that ends there."""

    NODES, LEAVES = (2 << DEPTH) - 1, 1 << DEPTH

    def __init__(self, rows: np.ndarray | None, low: np.ndarray, high: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.roots = [t * self.NODES for t in range(TREES)]
        self.feature, self.cut = np.full((TREES, self.NODES), -1, np.int8), np.zeros((TREES, self.NODES), np.float32)
        self.path = np.zeros((TREES, self.NODES), np.float32)
        wide = np.flatnonzero(high > low)
        for feature, cut in zip(self.feature, self.cut, strict=True):
            self._cuts(feature, cut, wide, low, high, rng)
        self.feature, self.cut, self.path = (x.reshape(-1) for x in (self.feature, self.cut, self.path))
        if rows is not None:
            self.settle(self.counts(rows))

    @cached_property
    def child(self) -> np.ndarray:
        """The first of two children of every inner node."""
        at = np.arange(len(self.feature))
        return np.where(self.feature < 0, at, at + at % self.NODES + 1)

    def _cuts(self, feature: np.ndarray, cut: np.ndarray, wide: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> None:
        low, high = low[None], high[None]
        for d in range(DEPTH):
            first, n = (1 << d) - 1, 1 << d
            f, each = rng.choice(wide, n) if len(wide) else np.zeros(n, np.int64), np.arange(n)
            at = rng.uniform(low[each, f], high[each, f]) if len(wide) else np.full(n, -np.inf)
            feature[first : first + n], cut[first : first + n] = f, at
            low, high = low.repeat(2, 0), high.repeat(2, 0)
            if len(wide):
                high[2 * each, f] = low[2 * each + 1, f] = at

    def _leaves(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaf of every row, counted from the first of its tree, tree by tree."""
        flat, base = np.ascontiguousarray(rows).reshape(-1), np.arange(len(rows)) * rows.shape[1]
        for t, root in enumerate(self.roots):
            feature, cut = self.feature[root : root + self.NODES], self.cut[root : root + self.NODES]
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node += node + 1 + (flat.take(base + feature.take(node)) >= cut.take(node))
            yield t, node - (self.LEAVES - 1)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many rows end in each leaf, a row a tree."""
        out = np.zeros((TREES, self.LEAVES), np.int64)
        for t, leaf in self._leaves(rows):
            out[t] = np.bincount(leaf, minlength=self.LEAVES)
        return out

    def settle(self, counts: np.ndarray) -> None:
        """Paths from how many good rows all tasks found in each leaf."""
        self.size = int(counts[0].sum())
        path, left = DEPTH + _depth(counts), counts
        for d in range(DEPTH - 1, -1, -1):
            left = left.reshape(TREES, -1, 2).sum(2)
            path = np.where((left < 2).repeat(self.LEAVES >> d, 1), d, path)
        self.path.reshape(TREES, -1)[:, self.LEAVES - 1 :] = path

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Towards 0 for rows on long paths, towards 1 for rows that few splits isolate."""
        total, ends = np.zeros(len(rows)), self.path.reshape(TREES, -1)[:, self.LEAVES - 1 :]
        for t, leaf in self._leaves(rows):
            total += ends[t].take(leaf)
        return 2.0 ** (-total / len(self.roots) / max(float(_depth(self.size)), 1e-9))


def calibrated(forest: Forest, rows: np.ndarray, good: np.ndarray) -> float:
    """The score that parts good and bad labelled rows best; without bad rows nothing is above it."""
    score = forest.score(rows)
    if good.all():
        return math.inf
    cuts = np.unique(score)
    bad_over = 1 - np.searchsorted(np.sort(score[~good]), cuts, "right") / (~good).sum()
    good_over = 1 - np.searchsorted(np.sort(score[good]), cuts, "right") / good.sum()
    return float(cuts[np.argmax(bad_over - LOSS * good_over)])


def parted(scores: DataFrame) -> float:
    """`calibrated` over a table of scores, each with its numbers of good and bad rows, of which some are bad: sums of whole
    ranges go to the driver, running sums are made within each range."""
    part = F.floor(F.col("score") * RANGES)
    per_part = scores.groupBy(part.alias("part")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # RANGES rows at most
    before, good, bad = [], 0, 0
    for r in per_part:
        before.append((r["part"], good, bad))
        good, bad = good + r["good"], bad + r["bad"]
    # as an Arrow table: rows would pass through Python workers of another kind, which stay
    ranges = pa.table(list(map(pa.array, zip(*before, strict=True))), ["part", "good_before", "bad_before"])
    upto = Window.partitionBy("part").orderBy("score")
    run = scores.withColumn("part", part).join(F.broadcast(scores.sparkSession.createDataFrame(ranges)), "part")
    over = [1 - (F.col(f"{c}_before") + F.sum(c).over(upto)) / F.lit(float(n)) for c, n in (("bad", bad), ("good", good))]
    return run.select("score", (over[0] - LOSS * over[1]).alias("gain")).orderBy(F.desc("gain"), "score").first()["score"]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _ratios(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, ratios array<double>"
_NAMES = ["doc_id", *COUNTS, "base_failed"]


def _measured(its: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, words in batches(its):
        counts, ratios = statistics(words)
        yield pa.record_batch([id_array(ids), *(pa.array(counts[:, k].copy()) for k in range(len(COUNTS))), pa.array(base_failed(counts)), _lists(ratios)], [*_NAMES, "ratios"])


def _counted(forest: Forest):
    def count(its: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TREES, Forest.LEAVES), np.int64)
        for b in its:
            if b.num_rows:
                total += forest.counts(_ratios(b.column("ratios")))
        if total.any():
            yield pa.record_batch([pa.array(range(TREES), pa.int32()), pa.array([planes(x) for x in total], pa.binary())], ["tree", "counts"])

    return count


def _summed(t: pa.Table) -> pa.Table:
    total = sum(unplanes(b, np.int64) for b in t.column("counts").to_pylist())
    return pa.table([t.column("tree")[:1], pa.array([planes(total)], pa.binary())], ["tree", "counts"])


def _scored(forest: Forest):
    def run(its: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in its:
            if b.num_rows:
                score, at = np.unique(forest.score(_ratios(b.column("ratios"))), return_inverse=True)
                good = np.bincount(at, weights=b.column("quality").to_numpy(), minlength=len(score)).astype(np.int64)
                yield pa.record_batch([pa.array(score), pa.array(good), pa.array(np.bincount(at) - good)], ["score", "good", "bad"])

    return run


def fitted(measured: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """Forest and threshold from all labelled rows of a table of statistics that pass the base rules, of texts that share an id
    one; None without good rows."""
    quality = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measured.where("not base_failed and doc_id is not null").groupBy("doc_id").agg(F.min("ratios").alias("ratios")).join(quality, "doc_id")
    rows = landed(rows.select("quality", "ratios"), "labelled")
    good = rows.where("quality = 1").select("ratios")
    try:
        width = range(RATIOS)
        box = rows.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), *(f(F.col("ratios")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in width)).first()
        if not box["good"]:
            return None
        forest = Forest(None, *(np.array([box[f"{name}{k}"] for k in width]) for name in ("low", "high")))
        found = good.mapInArrow(lean(_counted(forest)), "tree int, counts binary").groupBy("tree").applyInArrow(_summed, "tree int, counts binary").collect()  # a row a tree
        forest.settle(np.stack([unplanes(r["counts"], np.int64) for r in sorted(found, key=lambda r: r["tree"])]))
        if not box["bad"]:
            return forest, math.inf
        scores = landed(rows.mapInArrow(lean(_scored(forest)), "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "scores")
        try:
            return forest, parted(scores)
        finally:
            dropped(scores)
    finally:
        dropped(rows)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every row.

    kept is false where the base rules fail or the forest's score is above the threshold.  Null and empty texts have no
    words and fail.  Labels without a document, or with a null or another quality, are passed over; a document labelled
    both ways counts as bad; without any good labelled row that passes the base rules, the rules alone decide.  Repeated
    rows are judged alike.  Other columns are ignored.
    """
    measured = landed(texts(docs).mapInArrow(lean(_measured), _MEASURED), "measured")
    model = fitted(measured, labels)

    def run(its: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in its:
            if b.num_rows:
                score = model[0].score(_ratios(b.column("ratios"))) if model else np.zeros(b.num_rows)
                failed = b.column("base_failed").to_numpy(zero_copy_only=False)
                kept = ~failed & (score <= (model[1] if model else math.inf))
                yield pa.record_batch([*(b.column(c) for c in _NAMES), pa.array(kept), pa.array(score)], [*_NAMES, "kept", "score"])

    return measured.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that judge keeps; texts are not shuffled."""
    model = fitted(texts(docs).mapInArrow(lean(_measured), _MEASURED), labels)

    def run(its: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in its:
            at = 0
            text = b.column("text").fill_null("")
            for _, words in chunked(pa.nulls(b.num_rows, pa.int64()), text):
                counts, ratios = statistics(words)
                kept = ~base_failed(counts) & (model[0].score(ratios) <= model[1] if model else True)
                yield b.slice(at, words.n_docs).filter(pa.array(kept))
                at += words.n_docs

    return docs.mapInArrow(lean(run), docs.schema)
