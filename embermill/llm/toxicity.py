"""Toxicity by compression distance.

Two zstandard dictionaries of equal layout are made from labelled text: one of segments of toxic text, one of segments of
ordinary text, each followed by the words that most ordinary documents have.  Segments are one or two words as they follow
each other in the class, best first by coverage and contrast: the documents of the class that have it, times the log of how
much likelier it is there.  Each window of a text is compressed with both; what the toxic dictionary saves is what the window
has in common with toxic text alone.  A logistic model of those savings, calibrated on the labelled rows, gives the score.
Windows begin with a piece of the common part, so that even a short one is stored compressed and a saving shows.

The labelled rows are halved.  Each half is measured with dictionaries made from the other, so that the model and the size of
the dictionaries (the one of SIZES that ranks the labelled rows best) are chosen on rows which the dictionaries have
not seen; the final dictionaries are made from both halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import landed, texts

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Words in a window; bytes of common context before it.
WINDOW, CONTEXT = 8, 100
#: Words and bytes of the common part, bytes of class segments to choose from, documents that must have a segment, and segments
#: looked at, best first (the largest size holds fewer).
COMMON_WORDS, COMMON_BYTES, SIZES, LEAST, MOST = 1500, 12_000, (500, 1000, 2000), 2, 1000


@cache
def _compressors(ordinary: bytes, toxic: bytes, common: bytes):
    import zstandard

    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + b" " + common, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (ordinary, toxic)]


def savings(text: str, dictionaries: tuple[bytes, bytes, bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of the text."""
    words = text.lower().encode().split()
    context = dictionaries[2][-CONTEXT:]
    out = []
    for at in range(0, len(words), WINDOW << 12):
        part = words[at : at + (WINDOW << 12)]
        windows = [context + b" ".join(part[i : i + WINDOW]) + b" " for i in range(0, len(part), WINDOW)]
        plain, with_toxic = (_lengths(c, windows) for c in _compressors(*dictionaries))
        out.append(plain - with_toxic)
    return np.concatenate(out) if out else np.zeros(1, np.int64)


def _lengths(compressor, windows: list[bytes]) -> np.ndarray:
    found = compressor.multi_compress_to_buffer(windows, threads=1)
    return np.array([len(found[i]) for i in range(len(found))], np.int64)


def features(text: str, dictionaries: tuple[bytes, bytes, bytes]) -> list[float]:
    """Of all windows' savings: the largest, the three largest, the mean, and how many are high."""
    s = savings(text, dictionaries)
    top = np.sort(s)[::-1][:3]
    return [1.0, float(top[0]), float(top.sum()), float(s.mean()), float(np.sqrt(np.maximum(s - 1, 0).mean())), float((s >= 3).mean()), float(np.log1p((s >= 3).sum())), float(np.log1p(len(s)))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method on standardised features (the first is constant)."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * np.r_[0.0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


def rank(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a toxic and an ordinary row that the score puts in order, ties counting half."""
    values, back, n = np.unique(score, return_inverse=True, return_counts=True)
    place = (np.cumsum(n) - (n - 1) / 2)[back]
    bad = y.sum()
    return float((place[y == 1].sum() - bad * (bad + 1) / 2) / (bad * (len(y) - bad)))


def joined(segments: list[str], size: int) -> bytes:
    """The best segments, the best last (nearest to the text), up to `size` bytes; one inside another is left out."""
    out: list[bytes] = []
    n = 0
    for s in segments:
        b = s.encode()
        if not any(b in o for o in out):
            n += len(b) + 1
            if n > size:
                break
            out.append(b)
    return b" " + b" ".join(reversed(out))


class Model:
    def __init__(self, dictionaries: tuple[bytes, bytes, bytes]):
        self.dictionaries = dictionaries
        self.mean = self.scale = self.weights = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.mean, self.scale = np.r_[0.0, x[:, 1:].mean(0)], np.r_[1.0, x[:, 1:].std(0) + 1e-9]
        w = self.weights = _logistic((x - self.mean) / self.scale, y)
        margin = self.margin(x)
        order = np.argsort(-margin)
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
        best = int(np.argmax(f1))
        low = margin[order[best + 1]] if best + 1 < len(y) else margin[order[best]] - 1
        w[0] -= (margin[order[best]] + low) / 2  # 0.5 stands where documents are told apart best
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, text: str) -> float:
        x = np.array(features(text, self.dictionaries))
        return float(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from at most `sample` labelled rows (those of smallest hash) outside the held-out fold; None where a class
    is missing."""
    own = F.col("doc_id").cast("long")
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(own.alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = landed(texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")  # at most `sample` pairs of numbers
    rows = rows.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    size = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in size}) < 2:
        return None
    held = _segments(rows)
    common = [r["segment"] for r in held.where("good0 + good1 > 0 and not instr(segment, ' ') > 0").orderBy(F.desc(F.col("good0") + F.col("good1")), "segment").limit(COMMON_WORDS).collect()]
    end = joined(common, COMMON_BYTES)[1:] + b" "
    both = {halves: [_best(held, size, a, b, halves) for a, b in (("good", "bad"), ("bad", "good"))] for halves in ((0,), (1,), (0, 1))}

    def dictionaries(halves: tuple[int, ...], n: int) -> tuple[bytes, bytes, bytes]:
        ordinary, toxic = (joined(segments, n) for segments in both[halves])
        wide = max(len(ordinary), len(toxic))
        return ordinary.rjust(wide), toxic.rjust(wide), end

    unseen = [[dictionaries((1 - half,), n) for n in SIZES] for half in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[features(t, d) for d in unseen[h]] for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic").cast(pa.float64()), pa.array(x, pa.list_(pa.list_(pa.float64())))], ["doc_id", "y", "x"])

    # one row for each labelled id: of texts that share an id, one
    found = rows.mapInArrow(measure, "doc_id long, y double, x array<array<double>>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    y = found["y"].to_numpy()
    x = np.array([[list(f) for f in row] for row in found["x"]])
    models = [Model(dictionaries((0, 1), n)).fit(x[:, k], y) for k, n in enumerate(SIZES)]
    return max(zip(models, range(len(SIZES)), strict=True), key=lambda m: (rank(m[0].margin(x[:, m[1]]), y), -m[1]))[0]


def _segments(rows: DataFrame) -> DataFrame:
    """segment, and how many documents of each class and half have it: good0, good1, bad0, bad1."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = rows.select("doc_id", "toxic", "half", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    each = split.select("toxic", "half", F.explode(F.array_distinct(F.concat("w", pairs))).alias("segment"))
    counts = [F.count_if((F.col("toxic") == y) & (F.col("half") == h)).alias(f"{name}{h}") for name, y in (("good", 0), ("bad", 1)) for h in (0, 1)]
    return landed(each.groupBy("segment").agg(*counts).where(f"good0 + good1 + bad0 + bad1 >= {LEAST}"), "segments")


def _best(held: DataFrame, size: dict, own: str, other: str, halves: tuple[int, ...]) -> list[str]:
    """Segments of class `own` in these halves by coverage and contrast, best first."""
    n = {name: sum(size.get((int(name == "bad"), h), 0) for h in halves) for name in ("good", "bad")}
    mine, theirs = (sum(F.col(f"{name}{h}") for h in halves) for name in (own, other))
    score = mine * F.log((mine + 0.5) / (n[own] + 1) / ((theirs + 0.5) / (n[other] + 1)))
    top = held.where(mine >= LEAST).select("segment", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "segment").limit(MOST)
    return [r["segment"] for r in top.collect()]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is divisible by 5), score and predicted (1 from 0.5) of every row.

    Labels of held-out documents are never read; labels of another value or without a document are passed over; an id
    labelled both ways counts as toxic.  Null and empty texts have no savings and get the score that goes with none.  A
    null id is not held out.  Without labels of both classes every score is 0.  Other columns are ignored.
    """
    model = fitted(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(t) if model else 0.0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return texts(docs).withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
