"""Benchmark decontamination by template canonicalisation.  DataFrame functions only.

Words lose everything but letters and digits; numbers, names and units become typed placeholders and the rest is stripped of
letter case.  Windows of SIZE such words that keep LITERAL words or more as they are get a hash; documents and benchmark
items meet on it.  They also meet on all windows of plain words without letter case, those of fewer literal words too: the
type of a word hangs on its case, and a copy of numbers and names is a copy.  Windows of one document and item at the same
offset are one aligned stretch.  The slots of its template windows have to be consistent: equal values in the item stand
against equal values in the document, and different against different.  A re-parameterised question passes, a text that
only shares the sentence pattern by chance with clashing values does not.

Windows are made for documents that can hold one.  A window of 13 words holds seven stretches of seven words, one of which
begins at a multiple of seven; so a document that shares a window with an item shares such an anchor with it, and only
anchors are hashed in all documents.  Of the documents that meet an item's anchor, hashes and positions of all windows are
exploded, after which those without a partner are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, landed, texts

#: Words in a window, and how many of them must not be placeholders for the window to be joined by its template.
SIZE, LITERAL = 13, 6
#: Benchmark windows up to this number (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Words that count as units.
UNITS = "kg g mg lb lbs oz km m cm mm mi ft inch inches mile miles metre metres meter meters hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros pound pounds cent cents percent litre litres liter liters kmh mph degrees watts volts kilometers kilometres kilograms grams".split()


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")


def _split(bare: Column) -> Column:
    return F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_words(frame: DataFrame, text: Column) -> DataFrame:
    """frame with the words of a text, letters and digits only, in two arrays of equal length: `raw`, and `folded` without
    letter case.  Words without a letter or digit are left out; what folding makes of a letter beyond letters goes too."""
    bare = frame.withColumn("_bare", _bare(text))
    folded = F.upper(F.regexp_replace(F.lower("_bare"), r"\p{M}+", ""))  # capitals: ß and ẞ are SS, all sigmas one
    return bare.select(*(c for c in frame.columns if c != "text"), _split(F.col("_bare")).alias("raw"), _split(folded).alias("folded"))


def template_word(w: Column, folded: Column) -> Column:
    """`#n` for a number (with or without a unit attached), `#u` for a unit, `#p` for a capitalised word, else folded."""
    first, rest = F.substring(w, 1, 1), F.substring(w, 2, 1 << 20)
    capital = (F.lower(w) != w) & (F.lower(first) != first) & (F.length(w) > 1) & (F.lower(rest) == rest)  # the first is the cheapest
    return F.when(w.between("0", "9\U0010ffff"), "#n").when(folded.isin([u.upper() for u in UNITS]), "#u").when(capital, "#p").otherwise(folded)


def _windows(frame: DataFrame, sizes: list[int], *keys: str) -> DataFrame:
    """keys, size, verbatim, at and hash of every window of `size` words: of the template's, and verbatim of the folded ones.

    Hashes of 1, 4, 16 ... words are each made of four of the level below; a window is the few that cover it.  Thus a window
    costs a few steps whatever its size, and no slice copies the words for it.
    """
    level, has = 1, frame.select(*keys, F.size("raw").alias("n_words"), F.zip_with("raw", "folded", lambda w, f: F.xxhash64(template_word(w, f))).alias("t1"), F.transform("folded", lambda f: F.xxhash64(f)).alias("v1"))
    while 4 * level <= max(sizes, default=1):
        four = [k * level for k in range(4)]
        has = has.select(*keys, "n_words", *(F.col(f"{c}{x}") for c in "tv" for x in _levels(level)), *(_joined(F.col(f"{c}{level}"), four).alias(f"{c}{4 * level}") for c in "tv"))
        level *= 4

    def of(size: int, verbatim: bool) -> Column:
        p = max(x for x in _levels(level) if x <= size)
        h = F.col(f"{'v' if verbatim else 't'}{p}")
        starts = F.slice(h, F.lit(1), F.greatest(F.col("n_words") - (size - 1), F.lit(0)))
        cover = [*range(0, size - p, p), size - p]
        return F.transform(starts, lambda x, i: F.struct(F.lit(size).alias("size"), F.lit(verbatim).alias("verbatim"), i.alias("at"), F.xxhash64(x, *(F.get(h, i + k) for k in cover if k)).alias("hash")))

    return has.select(*keys, F.explode(F.concat(*(of(size, v) for size in sizes for v in (False, True)))).alias("w")).select(*keys, "w.size", "w.verbatim", "w.at", "w.hash")


def _anchors(frame: DataFrame, sizes: list[int], every: bool, *keys: str) -> DataFrame:
    """keys and hash of the anchors of windows of `size` words: half as many words, rounded up, at multiples of as many words as
    put exactly one of them into each window, or at every word; of template words, and of folded ones."""
    has = frame.select(*keys, F.zip_with("raw", "folded", template_word).alias("t"), "folded")

    def of(size: int, verbatim: bool) -> Column:
        n, words = (size + 1) // 2, "folded" if verbatim else "t"
        last = F.size(words) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(1 if every else size - n + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(2 * size + verbatim), *(F.get(words, i + k) for k in range(n))))

    return has.select(*keys, F.explode(F.concat(*(of(size, v) for size in sizes for v in (False, True)))).alias("anchor"))


def _levels(top: int) -> list[int]:
    return [4**k for k in range(top.bit_length()) if 4**k <= top]


def _joined(h: Column, at: list[int]) -> Column:
    return F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in at[1:])))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, prints: bool = False) -> DataFrame:
    """doc_id, contaminated, item_ids (the items found, in order) and n_windows (distinct aligned windows) of every row.

    A document is contaminated if it shares a stretch of template windows with an item, all slots of which are filled
    consistently, or a window that no template joins but that is equal save for letter case; an item of fewer words is one
    window.  Null and empty texts, on either side, match nothing.  Rows of one doc_id are told apart by their text;
    repeated rows and items are judged alike, a null item_id is listed as null.  Other columns are ignored.  With `prints`
    the hash of id and text that tells rows apart is a column too.
    """
    rows = texts(docs).withColumn("print", F.xxhash64("doc_id", "text"))
    items = with_words(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), F.coalesce("text", F.lit(""))).where(F.size("raw") > 0)
    short = [r[0] for r in items.where(F.size("raw") < size).select(F.size("raw")).distinct().collect()]  # below `size` values
    keys = ("item_id", "raw", "folded")
    wanted = _windows(items.where(F.size("raw") >= size), [size], *keys)
    for n in short:
        wanted = wanted.unionByName(_windows(items.where(F.size("raw") == n), [n], *keys))
    held = [F.slice(c, F.col("at") + 1, F.col("size")) for c in ("raw", "folded")]
    literal = F.size(F.filter(F.zip_with(*held, template_word), lambda w: ~w.startswith("#")))
    wanted = wanted.where(F.col("verbatim") | (literal >= F.least(F.lit(LITERAL), F.col("size")))).select("item_id", "size", "verbatim", F.col("at").alias("item_at"), "hash").distinct()
    small = wanted.count() <= BROADCAST_WINDOWS
    anchors = _anchors(items.where(F.size("raw") >= size), [size], True)
    for n in short:
        anchors = anchors.unionByName(_anchors(items.where(F.size("raw") == n), [n], True))
    anchors = anchors.distinct()
    anchored = _anchors(with_words(rows, F.col("text")), [size, *short], False, "print").join(F.broadcast(anchors) if anchors.count() <= BROADCAST_WINDOWS else anchors, "anchor", "left_semi")
    near = landed(rows.join(anchored.select("print").distinct(), "print", "left_semi"), "near")
    there = _windows(with_words(near, F.col("text")), [size, *short], "doc_id", "print")
    met = there.join(F.broadcast(wanted) if small else wanted, ["hash", "size", "verbatim"])
    window = F.struct(F.col("item_at"), F.col("size"))
    aligned = met.groupBy("doc_id", "print", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.collect_set(F.when(~F.col("verbatim"), window)).alias("found"), F.collect_set(F.when(F.col("verbatim"), window)).alias("same"))
    aligned = landed(aligned.withColumn("same", F.array_except("same", "found")), "aligned")  # read twice below; the windows of all texts are made once

    # slots of each aligned stretch: positions of the item that lie in a template window found
    texts_met = with_words(near.join(aligned.select("print").distinct(), "print", "left_semi"), F.col("text")).select(F.col("print").alias("own_print"), F.col("doc_id").alias("own_id"), F.col("raw").alias("doc"), F.col("folded").alias("doc_folded")).dropDuplicates(["own_print", "own_id"])
    both = aligned.join(texts_met, (F.col("print") == F.col("own_print")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).drop("own_print", "own_id")
    items_met = items.groupBy("item_id", "raw", "folded").agg(F.lit(1).alias("one")).select(F.col("item_id").alias("of_item"), F.col("raw").alias("item"), F.col("folded").alias("item_folded"))
    both = both.join(F.broadcast(items_met) if small else items_met, F.col("item_id").eqNullSafe(F.col("of_item")))

    # of several texts under one item_id, the one that stands at these positions counts
    def span(f: Column) -> Column:
        return F.sequence(f["item_at"], f["item_at"] + f["size"] - 1)

    def item(p: Column) -> Column:
        return template_word(F.get("item", p), F.get("item_folded", p))

    def doc(p: Column) -> Column:
        return template_word(F.get("doc", p + F.col("offset")), F.get("doc_folded", p + F.col("offset")))

    def equal(p: Column) -> Column:
        return (p < F.size("item")) & (F.get("item_folded", p) == F.get("doc_folded", p + F.col("offset")))

    places = F.array_distinct(F.flatten(F.transform("found", span)))
    fits = (F.size("found") > 0) & F.forall(places, lambda p: (p < F.size("item")) & (item(p) == doc(p)))
    slots = F.filter(F.transform(places, lambda p: F.struct(F.get("item", p).alias("i"), F.get("doc", p + F.col("offset")).alias("d"), item(p).alias("t"))), lambda s: s["t"].startswith("#"))
    both = both.withColumn("same", F.filter("same", lambda f: F.forall(span(f), equal))).withColumn("fits", fits).withColumn("slots", F.array_distinct(slots))

    def consistent(value) -> Column:
        def apart(*sides: str) -> Column:
            return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], *(value(s[side]) for side in sides)))))

        return (apart("i", "d") == apart("i")) & (apart("i", "d") == apart("d"))

    # equal but for letter case is equal enough, and different only by it different enough
    passed = F.when(F.col("fits") & (consistent(lambda v: v) | consistent(F.lower)), F.size("found")).otherwise(0)
    both = both.withColumn("windows", passed + F.size("same")).where("windows > 0")
    found = both.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"), F.sum("windows").alias("n_windows"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("print").alias("found_print"), F.transform("items", lambda s: s["item_id"]).alias("items"), "n_windows")
    out = rows.select("doc_id", "print").join(found, (F.col("print") == F.col("found_print")) & F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return out.select("doc_id", *(["print"] if prints else []), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, that `contaminated` does not find.

    Null and empty texts stay, repeated rows go or stay together, a null id is a value like others.  Columns of any name come
    through.
    """
    name = fresh(docs, "print")
    found = contaminated(docs, benchmark, size, prints=True).where("contaminated").select(F.col("print").alias(name)).distinct()
    own = F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    return docs.withColumn(name, own).join(found, name, "left_anti").drop(name)
