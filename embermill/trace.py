"""Spans of a flow's steps, and rows counted while they pass."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Spans:
    """Spans with name, start, seconds, parent and whether they failed; to be written as JSON lines."""

    def __init__(self) -> None:
        self.done: list[dict] = []
        self._open: list[str] = []

    @contextmanager
    def span(self, name: str, **fields: object) -> Iterator[dict]:
        row = {"name": name, "parent": self._open[-1] if self._open else None, "start": time.time(), "failed": False, **fields}
        self._open.append(name)
        try:
            yield row
        except BaseException:
            row["failed"] = True
            raise
        finally:
            self._open.pop()
            row["seconds"] = time.time() - row["start"]
            self.done.append(row)

    def lines(self) -> list[str]:
        return [json.dumps(r, sort_keys=True) for r in self.done]


def observed(reconciled: DataFrame, name: str = "store_lookup") -> tuple[DataFrame, Observation]:
    """The frame, and an observation that has items, hits and misses once an action has run over it."""
    seen = Observation(name)
    return reconciled.observe(seen, F.count(F.lit(1)).alias("items"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")), seen
