"""What the operators share: columns of documents, written tables in the cluster's shared folder, and words as numpy arrays.

Words are `[^\\x20\\x09-\\x0D]+` throughout.  Texts of a batch are laid end to end in one byte buffer, each followed by a
space, so that word borders, hashes and windows are array operations on that buffer and no word becomes a Python object.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time; a longer document makes a longer chunk.
CHUNK = 1 << 18
#: The same where results hang on where chunks end, or chunks are kept together.
LARGE = 1 << 20
#: Rows of a batch that become Python objects at a time.
SLICE = 512
#: Bytes from which a span is told by a digest.
LONG = 512
#: Stands for a null document id inside numpy code: the largest, so a null id is never the smaller one.
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F | 1
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty), with the other columns named; any further column stays behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *(docs[c] for c in more))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none (tests on one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="embermill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def landed(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: lineage ends there, and a lost executor costs no
    recomputation.  The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes landed tables that nothing reads any more, and lets the driver's collector find the shuffles that no plan refers
    to any more: Spark deletes their files then, not before."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for t in tables[:1]:
        t.sparkSession.sparkContext._jvm.System.gc()


def salted(rows: DataFrame, keys: DataFrame, key: str, *by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with the one row of keys that has their key.  A key that many rows have is spread over `salts` tasks by the
    columns `by`.  Both sides are shuffled: the planner knows the size of keys before they are multiplied, and from a
    compressed file, so that its own choice could broadcast a table much larger than its limit."""
    salt = fresh(rows, "salt")
    many = keys.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts))))).hint("merge")
    return rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(many, [key, salt], how).drop(salt)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which operators derive how many groups to deal documents into."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def deal(groups: int) -> Column:
    """The group of a document, by id and text: rows without an id are spread as well."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))


def ranges(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each of `parts` equal hash ranges that ordered hashes fall into; empty ranges cost nothing."""
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(h) else np.empty(0, np.int64)
    yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 8 * CHUNK:  # one very long text: computed for it alone, not kept
        return _powers.__wrapped__(base, n)
    size = CHUNK + (CHUNK >> 1)
    while size < n:
        size *= 2
    up, down = _powers(base, size)
    return up, down


class Words:
    """Words of some texts: byte spans in `data`, the text's number in `doc`, and on demand a 64-bit hash of each."""

    def __init__(self, parts: list[bytes]):
        self.n_docs = len(parts)
        self.data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self.sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.counts = np.diff(np.searchsorted(self.starts, self.bounds))
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A hash of each byte span: a polynomial in its bytes (A-Z lower-cased on demand), by prefix sums, then mixed.

        Unequal spans of LONG bytes and more can be constructed that a polynomial modulo 2**64 does not tell apart, whatever
        its base; these few have a digest instead.
        """
        up, down = powers(_BASE, len(self.data) + 1)
        x = (_LOWER[self.data] if lower else self.data).astype(np.uint64)
        x += np.uint64(1)
        x *= up[: len(x)]
        sums = np.empty(len(x) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(x, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(ends - starts >= LONG):
            part = self.data[starts[i] : ends[i]]
            h[i] = int.from_bytes(hashlib.blake2b((_LOWER[part] if lower else part).tobytes(), digest_size=8).digest(), "little")
        return h

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.spans(self.starts, self.ends, lower)

    def tally(self, chosen: np.ndarray) -> np.ndarray:
        """How many bytes of each text a boolean table of 256 byte values chooses."""
        sums = np.concatenate([[0], np.cumsum(chosen[self.data])])
        return sums[self.bounds[:-1] + self.sizes] - sums[self.bounds[:-1]]

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all windows of `size` words inside one text, and the number of the word each starts at."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        up, down = powers(_WINDOW_BASE, len(hashes) + 1)
        sums = np.empty(len(hashes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix((sums[at + size] - sums[at]) * down[at]), at


def sliced(b: pa.RecordBatch | pa.ChunkedArray | pa.Array) -> Iterator:
    for at in range(0, len(b), SLICE):
        yield b.slice(at, SLICE)


def _objects(column: pa.ChunkedArray | pa.Array) -> Iterator:
    for part in sliced(column):
        yield from part.to_pylist()


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The work of a task, after which the worker gives free memory back to the system: it waits for other stages' tasks, beside
    an executor that needs the memory, and would keep the most it ever had."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _libc():
                _libc().malloc_trim(0)

    return run


def chunked(ids: pa.ChunkedArray | pa.Array, text: pa.ChunkedArray | pa.Array, size: int = CHUNK) -> Iterator[tuple[np.ndarray, Words]]:
    """Document ids and words, some texts of about `size` bytes at a time."""
    parts: list[bytes] = []
    at: list[int] = []
    held = 0
    for i, t in zip(_objects(ids), _objects(text.cast(pa.binary())), strict=True):
        if parts and held + len(t) > size:
            yield np.array(at, np.int64), Words(parts)
            parts, at, held = [], [], 0
        parts.append(t)
        at.append(NO_ID if i is None else i)
        held += len(t) + 1
    if parts:
        yield np.array(at, np.int64), Words(parts)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def planes(x: np.ndarray) -> bytes:
    """Sorted or slowly changing 64-bit numbers as differences, byte plane by byte plane, which shuffle compression shrinks."""
    if not len(x):
        return b""
    d = np.empty_like(x)
    d[0] = x[0]
    np.subtract(x[1:], x[:-1], out=d[1:])
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes, dtype=np.uint64) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).reshape(-1)
    return np.cumsum(d, dtype=dtype)


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Words]]:
    """`chunked` over the doc_id and text columns of a partition."""
    for b in it:
        yield from chunked(b.column("doc_id"), b.column("text"))
