"""Memoisation as joins and aggregations: look up, deduplicate, claim, number, chunk, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that one task numbers at a time.
STRETCH = 1 << 18


def reconcile(items: DataFrame, store: DataFrame) -> DataFrame:
    """Every item with is_hit and the stored vector (null for a miss); order columns and repeats stay as they are."""
    return items.join(store.select("key", "vector"), "key", "left").withColumn("is_hit", F.col("vector").isNotNull())


def unique_misses(reconciled: DataFrame, order: str = "item", carry: Sequence[str] = ("text", "model")) -> DataFrame:
    """One row a missed key: the first item that asked for it, how many did, and that item's `carry` columns."""
    return reconciled.where("not is_hit").groupBy("key").agg(F.min(order).alias("first_item"), F.count("*").alias("n_items"), *(F.min_by(c, order).alias(c) for c in carry))


def first_places(reconciled: DataFrame, by: str = "request_id", order: str = "item") -> DataFrame:
    """For every missed item of a request the rank of its key by the key's first place there (0 first): equal keys share a
    rank, which is the place of their vector among those fetched."""
    missed = reconciled.where("not is_hit")
    first = missed.groupBy(by, "key").agg(F.min(order).alias("first"))
    rank = first.withColumn("unique_index", F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1)  # a request's items only
    return missed.join(rank.select(by, "key", "unique_index"), [by, "key"])


def claims(requests: DataFrame) -> DataFrame:
    """Which request of those that share a key fetches it (claimed) and which wait: the earliest, then the smallest id.

    The claimers are found by an aggregation that is combined before it is shuffled, and joined back by time, id and key:
    the requests for a key that everybody asks for are spread over all tasks.
    """
    first = requests.groupBy("key").agg(F.min(F.struct("ts", "request_id")).alias("first"))
    claimer = first.select("first.ts", "first.request_id", "key", F.lit(True).alias("claimed"))
    return requests.join(claimer, ["ts", "request_id", "key"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def numbered(rows: DataFrame, by: Sequence[str], order: str, name: str = "n", stretch: int = STRETCH) -> DataFrame:
    """rows with their number (0 first) within `by` in the order of a whole-number column without repeats.

    The order column is cut into stretches; each is numbered by itself, a stretch of a group at a time, and begins where
    the counts of the stretches before it end.  Only those counts are summed up a group at a time.
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / stretch))
    counts = rows.groupBy(*by, "_stretch").agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select(*by, "_stretch", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(order)) - 1
    return rows.withColumn("_local", local).join(start, [*by, "_stretch"]).withColumn(name, F.col("_start") + F.col("_local")).drop("_stretch", "_start", "_local")


def chunks(unique: DataFrame, max_batch: int | Column, by: str | Sequence[str] = "provider", order: str = "first_item") -> DataFrame:
    """The provider call that each unique miss goes into, and its place in it."""
    size = F.lit(max_batch) if isinstance(max_batch, int) else max_batch
    by = [by] if isinstance(by, str) else list(by)
    placed = numbered(unique, by, order, "_n")
    return placed.withColumn("chunk", F.floor(F.col("_n") / size)).withColumn("position", F.col("_n") % size).drop("_n")


def stats(reconciled: DataFrame, *by: str) -> DataFrame:
    """Hits and misses count positions, not keys."""
    return reconciled.groupBy(*by).agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
