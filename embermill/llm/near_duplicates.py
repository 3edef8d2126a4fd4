"""Near duplicates by HyperMinHash: documents whose shingle sets have a Jaccard similarity of `threshold` per cent or more.

Each distinct shingle set is one node.  A node has BUCKETS registers.  A register holds, in 16 bits, the leading zeros and ten
mantissa bits of the smallest hash that fell into its bucket; an empty bucket borrows another's.  BANDS bands of ROWS
registers bring nodes together: at a similarity of 0.85 a pair shares no band with probability (1 - 0.85**5)**51, about
1e-13, at 0.8 2e-9.  Register agreement, corrected for chance collisions, estimates the similarity; pairs six standard errors
below the threshold go, all others are confirmed on the full sets.

No pair of nodes is ever a row.  Of bands with the same members one is kept.  A band's members are dealt into blocks of
about BLOCK nodes, and a task meets the members of one block in numpy: estimate, confirmation, and of the links only those
that join two parts.  Bands of several blocks go on: their members are split into the component that most of them belong to by
then and the rest, and each block of the rest meets every block of the band, in the same way.  So each two nodes that
share a band are either in one component before they would meet, or meet; there is no cap.  What remains beyond linear work
is that last step: a band of c members, r of them outside its largest component, costs r * c / BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Words, chunked, dropped, fresh, id_array, landed, lean, mix, planes, salted, texts, unplanes

BUCKETS, ROWS, BANDS, MANTISSA = 256, 5, 51, 10
_BITS, _MIN = 52, 44  # bits of a shingle hash that are kept; those below the bucket number
_DOCS = 1 << (64 - _BITS)  # texts in a chunk at most
#: Nodes of a block, and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Empty buckets borrow from these in turn, the first that is not empty.
_TRIES = np.random.default_rng(7).integers(0, BUCKETS, (64, BUCKETS))


def _shingles(words: Words, size: int) -> np.ndarray:
    """Distinct shingles of the chunk in order: the text's number above 52 bits of hash.  A text of fewer than `size` words
    is one shingle, a text without words none."""
    h = words.hashes(lower=True)
    w, at = words.windows(size, h)
    first = np.concatenate([[0], np.cumsum(words.counts)])[:-1]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    whole = words.counts[short].astype(np.uint64)
    for k in range(size - 1):
        more = words.counts[short] > k
        whole[more] = mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[more]] + k])
    docs = np.concatenate([words.doc[at], short]).astype(np.uint64)
    key = (docs << np.uint64(_BITS)) | (np.concatenate([w, whole]) >> np.uint64(64 - _BITS))
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def _registers(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text, leading zeros and mantissa of the least value of each bucket, empty buckets filled by borrowing."""
    slot = keys >> np.uint64(_MIN)
    least = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, np.int64)
    value = (keys[least] & np.uint64((1 << _MIN) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(value)
    mantissa = np.where(value > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    own = np.zeros((n, BUCKETS), np.uint16)
    own[doc[least], (slot[least] & np.uint64(BUCKETS - 1)).astype(np.int64)] = (((_MIN - exponent) << MANTISSA) | mantissa) + 1
    full = own.copy()
    for turn in _TRIES:
        d, b = np.nonzero(full == 0)
        if not len(d):
            break
        full[d, b] = own[d, turn[b]]
    for d in np.flatnonzero((full == 0).any(1)):
        there = np.flatnonzero(own[d])
        if len(there):
            gap = np.flatnonzero(full[d] == 0)
            full[d, gap] = own[d, there[np.searchsorted(there, gap) % len(there)]]
    return full


def _bands(registers: np.ndarray) -> np.ndarray:
    r = registers[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(r), 0)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return h


def _sketch(size: int, sets: bool):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _DOCS):
                part = b.slice(at, _DOCS)
                done = 0
                for ids, words in chunked(part.column("doc_id"), part.column("text")):
                    yield rows(ids, part.column("print").slice(done, words.n_docs), _shingles(words, size), words.n_docs)
                    done += words.n_docs

    def rows(ids: np.ndarray, prints: pa.Array, keys: np.ndarray, n: int) -> pa.RecordBatch:
        doc = (keys >> np.uint64(_BITS)).astype(np.int64)
        count = np.bincount(doc, minlength=n)
        cut = np.concatenate([[0], np.cumsum(count)])
        body = keys & np.uint64((1 << _BITS) - 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(body), dtype=np.uint64)])
        node = mix(sums[cut[1:]] - sums[cut[:-1]] + count.astype(np.uint64)).view(np.int64)
        if sets:
            packed = [planes(body[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            registers = pa.array([r.tobytes() for r in _registers(keys, doc, n)], pa.binary())
            return pa.record_batch([pa.array(node), pa.array(count), registers, pa.array(packed, pa.binary())], ["node", "n", "registers", "members"])
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(_bands(_registers(keys, doc, n)).view(np.int64).reshape(-1)))
        return pa.record_batch([id_array(ids), prints, pa.array(count), pa.array(node), bands], ["doc_id", "print", "n", "node", "bands"])

    return sketch


def _cells(n: np.ndarray) -> np.ndarray:
    """For sets of n members, the probability that a register's least value has each number of leading zeros."""
    zeros = np.arange(_MIN)
    width = n[:, None] / BUCKETS
    return np.exp(-width * 2.0 ** -(zeros + 1)) - np.exp(-width * 2.0**-zeros)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and of m members agree by chance, a row for each n and a column for
    each m: both least values fall into the same cell, of which each power of two below a bucket's width has 2**MANTISSA."""
    return _cells(np.asarray(n, float)) @ _cells(np.asarray(m, float)).T / (1 << MANTISSA)


def estimated(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Corrected estimates of the similarity of all rows of registers of the left with all of the right."""
    same = np.zeros((len(left), len(right)), np.int32)
    for a in range(0, BUCKETS, 64):
        if same.size <= 1 << 12:
            same += (left[:, None, a : a + 64] == right[None, :, a : a + 64]).sum(2, dtype=np.int32)
        else:
            part = np.zeros(same.shape, np.uint8)
            for k in range(a, a + 64):
                part += left[:, k, None] == right[None, :, k]
            same += part
    c = chance(n, m)
    return (same / BUCKETS - c) / (1 - c)


class _Side:
    """The members of one block: nodes, the components known so far, set sizes, registers and sets."""

    def __init__(self, t: pa.Table):
        self.node, self.root, self.n = (t.column(c).to_numpy() for c in ("node", "root", "n"))
        self.registers = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        self.sets = [unplanes(b) for b in t.column("members").to_pylist()]


def linked(left: _Side, right: _Side | None, threshold: int) -> list[tuple[int, int]]:
    """Links between two blocks, or inside one: enough of them to join whatever the similar pairs join."""
    t, within = threshold / 100, right is None
    right = left if right is None else right
    n, m = left.n.astype(float), right.n.astype(float)
    maybe = (100 * np.minimum(n[:, None], m) >= threshold * np.maximum(n[:, None], m)) & (left.root[:, None] != right.root)
    if within:
        maybe = np.triu(maybe, 1)
    if not maybe.any():
        return []
    filled = BUCKETS * (1 - np.exp(-np.minimum(n[:, None], m) / BUCKETS))  # borrowed registers add no independent draws
    maybe &= estimated(left.registers, right.registers, n, m) >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(filled, 1))
    rows = np.flatnonzero(maybe.any(1))
    if not len(rows):
        return []
    cols = np.flatnonzero(maybe.any(0))
    values, place = np.unique(np.concatenate([left.sets[i] for i in rows] + [right.sets[j] for j in cols]), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum([len(left.sets[i]) for i in rows] + [len(right.sets[j]) for j in cols])])
    theirs = {int(j): place[cut[len(rows) + k] : cut[len(rows) + k + 1]] for k, j in enumerate(cols)}
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out, mark = [], np.zeros(len(values), bool)
    for k, i in enumerate(rows):
        mine = place[cut[k] : cut[k + 1]]
        root = int(left.root[i])
        others = [int(j) for j in np.flatnonzero(maybe[i]) if top(int(right.root[j])) != top(root)]
        if not others:
            continue
        mark[mine] = True
        sizes = np.array([len(theirs[j]) for j in others])
        common = np.add.reduceat(mark[np.concatenate([theirs[j] for j in others])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        mark[mine] = False
        for j in np.array(others)[100 * common >= threshold * (len(mine) + sizes - common)].tolist():
            a, b = top(root), top(int(right.root[j]))
            if a != b:
                parent[a] = b
                out.append((int(left.node[i]), int(right.node[j])))
    return out


def _runs(t: pa.Table) -> np.ndarray:
    """Where the rows of each meeting begin in rows ordered by meeting."""
    cols = [t.column(c).to_numpy() for c in ("band", "p", "q")]
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))


def _meet(threshold: int):
    def links(t: pa.Table) -> list[tuple[int, int]]:
        p, q, block = (t.column(c)[0].as_py() for c in ("p", "q", "block"))
        if p == q:
            return linked(_Side(t), None, threshold) if t.num_rows > 1 else []
        at = t.column("block").to_numpy() == p
        left, right = t.filter(pa.array(at)), t.filter(pa.array(~at))
        return linked(_Side(left), _Side(right), threshold) if left.num_rows and right.num_rows else []

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            first = _runs(t)
            out = [x for a, z in zip(first[:-1], first[1:], strict=True) for x in links(t.slice(a, z - a))]
            held = t.slice(first[-1]).combine_chunks().to_batches()
            yield _pairs(out)
        if held:
            yield _pairs(links(pa.Table.from_batches(held)))

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return meet


def _met(meetings: DataFrame, kit: DataFrame, threshold: int) -> DataFrame:
    """Links found in meetings (band, p, q, block, root, node): blocks p and q of a band."""
    full = meetings.join(kit, "node").select("band", "p", "q", "block", "root", "node", "n", "registers", "members")
    ordered = full.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return landed(ordered.mapInArrow(lean(_meet(threshold)), "a long, b long").distinct(), "links")


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node, c, k): members of bands that several nodes share, one band for each set of members, with the band's
    number of members and of blocks."""
    bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    several = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    every = landed(salted(bands, several, "band", "node"), "bands")
    print_ = every.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y"))
    one = print_.groupBy("c", "total", "x", "y").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    out = landed(salted(every.select("band", "node"), one.select("band", "c", blocks.alias("k")), "band", "node"), "members")
    dropped(every)
    return out


def _sets(live: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, n, registers and the whole set of every live node, from the texts of its first documents."""
    wanted = live.select("node").distinct().join(nodes.select("node", "first_id"), "node")
    found = docs.join(wanted.select("first_id").distinct(), docs["doc_id"].eqNullSafe(F.col("first_id")), "left_semi")
    # a doc_id may stand for several texts; of repeated sets one row is enough
    members = found.mapInArrow(lean(_sketch(size, True)), "node long, n long, registers binary, members binary")
    return landed(wanted.drop("first_id").join(members, "node").dropDuplicates(["node"]), "sets")


def _links(live: DataFrame, kit: DataFrame, threshold: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another."""
    block = F.pmod(F.xxhash64("band", "node"), F.col("k")).cast("int")
    placed = live.select("band", "node", "k", block.alias("block"))
    links = _met(placed.select("band", "node", "block", F.col("block").alias("p"), F.col("block").alias("q"), F.col("node").alias("root")), kit, threshold)
    found = components(links)
    large = placed.where("k > 1")
    if large.isEmpty():
        return found

    # bands of several blocks: the rest of each against its largest component and among itself
    parts = landed(large.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "parts")
    sizes = parts.groupBy("band", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("all")).where("main.c < all")
    main = main.select("band", F.col("main.root").alias("main"), F.ceil(F.col("main.c") / BLOCK).cast("int").alias("k"), F.ceil((F.col("all") - F.col("main.c")) / BLOCK).cast("int").alias("r"))
    rest = F.col("root") != F.col("main")
    dealt = F.xxhash64("node", "band")
    sides = salted(parts, main, "band", "node").select("band", "node", "root", "k", "r", rest.alias("rest"), F.when(rest, F.col("k") + F.pmod(dealt, F.col("r"))).otherwise(F.pmod(dealt, F.col("k"))).cast("int").alias("block"))
    partners = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("k") + F.col("r") - 1)).otherwise(F.sequence(F.col("k"), F.col("k") + F.col("r") - 1))
    meetings = sides.select("band", "node", "root", "block", F.explode(partners).alias("other"))
    meetings = meetings.select("band", "node", "root", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    more = _met(meetings, kit, threshold)
    return components(links.unionByName(more))


def _classes(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, print, n, node, component_id and keeper of every row: the hash of its text, its set's size and node, the
    smallest id of its component, and the node of the component whose document of that id stands for it."""
    own = texts(docs).withColumn("print", F.xxhash64("text"))
    rows = landed(own.mapInArrow(lean(_sketch(size, False)), "doc_id long, print long, n long, node long, bands array<long>"), "sketch")
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    nodes = landed(least, "nodes")
    live = _shared_bands(nodes)
    kit = _sets(live, nodes, own, size)
    found = _links(live, kit, threshold)
    dropped(live, kit)
    order = F.struct(F.col("first_id").isNull(), "first_id", "node")
    named = found.join(nodes.select("node", "first_id"), "node").groupBy("root").agg(F.min(order).alias("least")).select("root", F.col("least.first_id").alias("component_id"), F.col("least.node").alias("keeper"))
    named = landed(salted(found, named, "root", "node").select("node", "component_id", "keeper"), "named")
    name = nodes.select("node", "first_id").join(named, "node", "left").select("node", F.when(F.col("keeper").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keeper", "node").alias("keeper"))
    # many rows may have one node: an exact copy that everybody has
    out = salted(rows.where("n > 0").select("doc_id", "print", "n", "node"), name, "node", "print", "doc_id")
    alone = rows.where("n = 0").select("doc_id", "print", "n", "node", F.col("doc_id").alias("component_id"), F.col("node").alias("keeper"))
    return out.select(alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (it is its own component) of each row.

    Sets are the distinct `size`-word shingles of the text, A-Z lower-cased; a text of fewer words is one shingle.  Texts
    without words, null texts among them, have empty sets, are linked with nothing and kept.  Rows with a null doc_id take
    part like others but never name a component that has an id; alone, their component is null and they are kept.  Rows
    that repeat a doc_id with the same text are one document; all of them are listed, and kept alike.  Other columns are
    ignored.
    """
    found = _classes(docs, size, threshold)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stand for their components: of each, one row of the smallest doc_id.

    Texts without words all stay; of rows that repeat a doc_id and text one stays.  A component without any id keeps one
    text.  Columns of any name come through.
    """
    found = _classes(docs, size, threshold)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & ((F.col("n") == 0) | (F.col("node") == F.col("keeper")))
    one, two = fresh(docs, "print"), fresh(docs, "id")
    kept = found.where(stays).select(F.xxhash64("doc_id", "print").alias(one), F.coalesce("doc_id", F.lit(-1)).alias(two)).distinct()
    own = F.col("doc_id").cast("long")
    rows = docs.withColumns({one: F.xxhash64(own, F.xxhash64(F.coalesce("text", F.lit("")))), two: F.coalesce(own, F.lit(-1))})
    return rows.join(kept, [one, two], "left_semi").dropDuplicates([one, two]).drop(one, two)
