"""Settings of the flow from environment variables or the session's configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .functions.models import BATCHES, BEDROCK_ENDPOINT, VERTEX_ENDPOINT

PREFIX = "EMBERMILL_"


def seconds(setting: str | None) -> int | None:
    """A positive whole number of seconds; everything else means never."""
    return int(setting) if setting and re.fullmatch(r"\+?[0-9]{1,18}", setting) and int(setting) > 0 else None


@dataclass(frozen=True)
class Config:
    """An empty or unset variable means the default; an unknown storage or authentication mode means the first one named."""

    store: str = "parquet"
    store_path: str = "./data"
    ttl: int | None = None
    openai_base_url: str = "https://api.openai.com"
    mistral_base_url: str = "https://api.mistral.ai"
    gemini_base_url: str = "https://generativelanguage.googleapis.com"
    huggingface_base_url: str = "https://router.huggingface.co/hf-inference"
    azure_openai_base_url: str | None = None
    azure_foundry_base_url: str | None = None
    azure_foundry_api_version: str = "2024-05-01-preview"
    azure_auth_mode: str = "bearer"
    bedrock_region: str = "us-east-1"
    bedrock_endpoint_template: str = BEDROCK_ENDPOINT
    vertex_project: str | None = None
    vertex_location: str = "us-central1"
    vertex_endpoint_template: str = VERTEX_ENDPOINT

    @classmethod
    def read(cls, found: Mapping[str, str | None]) -> Config:
        """From variables named like the fields, in capitals, with the prefix."""
        given = {f.name: found.get(PREFIX + f.name.upper()) for f in fields(cls)}
        out = {k: v for k, v in given.items() if v}
        out["ttl"] = seconds(given["ttl"])
        out["store"] = given["store"] if given["store"] in ("parquet", "bytes") else "parquet"
        out["azure_auth_mode"] = "api-key" if given["azure_auth_mode"] == "api-key" else "bearer"
        return cls(**out)

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        """Environment variables, and over them spark.embermill.<field>."""
        own = {PREFIX + f.name.upper(): spark.conf.get(f"spark.embermill.{f.name}", None) for f in fields(cls)}
        return cls.read({**os.environ, **{k: v for k, v in own.items() if v is not None}})

    def registry(self, spark: SparkSession) -> DataFrame:
        """name, base_url, strategy (null: by the model's name), text, image, version and max_batch of every provider that is
        configured: a handful of rows.  The first of the Azure surfaces that has a base URL makes azure known."""
        rows = [(name, getattr(self, f"{name}_base_url"), name, True, name == "gemini", "1", BATCHES[name]) for name in ("openai", "mistral", "gemini", "huggingface")]
        rows += [("bedrock", self.bedrock_endpoint_template, None, True, False, "1", None), ("vertexai", self.vertex_endpoint_template, None, True, False, "1", BATCHES["vertex"])]
        if azure := self.azure_openai_base_url or self.azure_foundry_base_url:
            rows.append(("azure", azure, None, True, False, "1", BATCHES["azure"]))
        return spark.createDataFrame(rows, "name string, base_url string, strategy string, text boolean, image boolean, version string, max_batch int")
