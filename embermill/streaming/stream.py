"""The batch flow over a stream of items: each micro-batch is reconciled, fetched and written back as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import memo
from ..plans.engine import run
from ..sources.providers import EmbeddingProvider
from ..sources.store import EmbeddingStore


def embed_stream(items: DataFrame, store: EmbeddingStore, provider: EmbeddingProvider, out: str, checkpoint: str, ttl: int | None = None, now: int = 0) -> StreamingQuery:
    """Writes each batch's items with is_hit and vector to `out`, a folder a batch.

    Batches run one after the other, so a key that one batch fetched is a hit in the next: across batches as within one,
    a key is fetched once.  A batch that is run again finds what it had looked up and fetched under `checkpoint` and
    replaces its own output by the same rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = run(df, store, provider, number + 1, ttl, now, at=f"{checkpoint}/batches/{number}")
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_stream(items: DataFrame, store: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream of items joined with a static store."""
    return memo.reconcile(items, store).drop("vector").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
