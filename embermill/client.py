"""The engine as a plain client sees it: lists of texts or images in, vectors in order and hit counts out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .config import Config
from .plans import engine, requests
from .sources.providers import EmbeddingProvider, WireProvider
from .sources.store import EmbeddingStore
from .tables import new_path, written
from .trace import Spans

FRAME = "request_id long, provider string, authorization string, body string"


@dataclass
class Answer:
    status: int
    vectors: list[list[float]] = field(default_factory=list)
    hits: int | None = None
    misses: int | None = None
    total_tokens: int = 0
    deleted: int | None = None


class Client:
    """For a few requests from the driver; frames of many go through plans.requests."""

    def __init__(self, spark: SparkSession, store: EmbeddingStore, config: Config | None = None, provider: EmbeddingProvider | None = None, budget: float = 5.0):
        self.spark, self.store, self.budget = spark, store, budget
        self.config = config or Config.of(spark)
        self.provider = provider or WireProvider()
        self.spans, self.seq = Spans(), 0

    def _frame(self, provider: str, key: str, model: str, inputs: str | list[str], images: bool):
        body = json.dumps({"model": model, "input": inputs}, ensure_ascii=False)
        return requests.judged(self.spark.createDataFrame([(0, provider, f"Bearer {key}", body)], FRAME), self.config, images)

    def embed(self, provider: str, key: str, model: str, inputs: str | list[str], images: bool = False) -> Answer:
        self.seq += 1
        seen = self._frame(provider, key, model, inputs, images)
        with self.spans.span("embed"):
            done, fetched = engine.billed(requests.items(seen, self.config, images), self.store, self.provider, self.seq, self.config.ttl, order="place", at=new_path(self.spark, "client"))
            row = requests.answers(seen, written(done.drop("api_key"), new_path(self.spark, "answer")), fetched).first()
        body = json.loads(row["body"])
        data = sorted(body.get("data", []), key=lambda d: d["index"])
        return Answer(row["status"], [d["embedding"] for d in data], row["hits"], row["misses"], body.get("usage", {}).get("total_tokens", 0))

    def delete(self, provider: str, key: str, model: str, inputs: str | list[str], images: bool = False) -> Answer:
        self.seq += 1
        seen = self._frame(provider, key, model, inputs, images)
        gone = requests.deletions(seen, self.config, images)
        with self.spans.span("store_delete"):
            engine.within(self.spark, self.budget, lambda: self.store.delete(gone, self.seq))
        row = requests.delete_answers(seen, gone).first()
        return Answer(row["status"], deleted=json.loads(row["body"]).get("deleted"))
