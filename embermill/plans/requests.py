"""Requests in, responses and deletions out: frames of (request_id, provider, authorization, body) as a batch or a stream.

A request is judged as a whole: its body, its credential, its provider, its images, its model's name.  Those that pass become
items, one a position, with the key that the store knows them by; the credential travels with the items to the provider call
and is stored nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import keys, models, wire

ITEM = ["request_id", "item", "place", "content_type", "owner", "api_key", "provider", "version", "scope", "model", "strategy", "endpoint", "model_id", "qualifier", "max_batch", "text", "mime", "data", "key"]


def resolved(config: Config) -> Column:
    """What the model's name means to its provider: canonical, model_id, qualifier, endpoint, strategy, max_batch, or null."""
    m, name = F.col("model"), F.col("provider")
    clouds = {
        "bedrock": models.bedrock(m, config.bedrock_region, config.bedrock_endpoint_template),
        "vertexai": models.vertex(m, config.vertex_location, config.vertex_project, config.vertex_endpoint_template),
        "azure": models.azure(m, config.azure_foundry_api_version, config.azure_openai_base_url, config.azure_foundry_base_url),
    }
    out = F.when(F.col("strategy").isNotNull(), models.simple(m, F.col("base_url"), F.col("strategy")))
    for cloud, meaning in clouds.items():
        out = out.when(name == cloud, meaning)
    return out


def scope(config: Config) -> Column:
    """What else tells vectors apart: the base URL, and for clouds endpoint, canonical model and the kit's version."""
    cloud = keys.cache_scope(F.col("r.endpoint"), F.col("r.canonical"), F.lit("kit1"))
    return F.when(F.col("strategy").isNotNull(), F.col("base_url")).otherwise(cloud)


def judged(frames: DataFrame, config: Config, images: bool = False) -> DataFrame:
    """frames with status, and inputs, model, token and r (the resolved model) of those that pass.

    400 for a broken body, 422 for a missing model or wrong input, 401 without a bearer token, 404 for a provider that is
    not registered for the kind, 400 for an image that is no data URI, 502 for a model that its provider cannot mean.  A
    request without inputs is answered at once, whatever its model.
    """
    body = F.col("body")
    kind = F.col("image" if images else "text")
    known = frames.withColumns({"inputs": wire.input_texts(body), "model": wire.model_name(body), "token": wire.bearer_token(F.col("authorization"))})
    registry = config.registry(frames.sparkSession)  # a handful of rows
    known = known.join(F.broadcast(registry.withColumnRenamed("name", "provider")), "provider", "left").withColumn("r", resolved(config))
    first = wire.status(wire.is_json(body), F.col("inputs"), F.col("model"), F.col("token"), F.coalesce(kind, F.lit(False)))
    if images:
        first = F.when((first == 200) & F.exists("inputs", lambda u: wire.data_uri(u).isNull()), 400).otherwise(first)
    last = F.when((first == 200) & F.col("r").isNull() & (F.size("inputs") > 0), wire.failure(F.lit("provider"))).otherwise(first)
    return known.withColumn("status", last)


def items(judged: DataFrame, config: Config, images: bool = False) -> DataFrame:
    """The ITEM columns of every position of the requests that pass; place orders all of them (a request has fewer than 2**20
    inputs)."""
    rows = judged.where("status = 200").select("*", F.posexplode("inputs").alias("item", "input")).withColumns({"owner": keys.owner_id(F.col("token")), "scope": scope(config)})
    if images:
        rows = rows.withColumn("uri", wire.data_uri(F.col("input"))).withColumns({"text": F.lit(None).cast("string"), "mime": F.col("uri.mime"), "data": F.col("uri.data")}).drop("uri", "image")
        key = keys.image_key(*(F.col(c) for c in ("owner", "provider", "scope", "model", "version", "mime", "data")))
    else:
        rows = rows.drop("text").withColumns({"text": keys.normalize_text(F.col("input")), "mime": F.lit(None).cast("string"), "data": F.lit(None).cast("string")})
        key = keys.text_key(*(F.col(c) for c in ("owner", "provider", "scope", "model", "version", "text")))
    rows = rows.drop("strategy", "max_batch").select("*", "r.strategy", "r.endpoint", "r.model_id", "r.qualifier", "r.max_batch")
    return rows.withColumns({"content_type": F.lit("image" if images else "text"), "api_key": F.col("token"), "key": key, "place": F.shiftleft(F.col("request_id").cast("long"), 20) + F.col("item")}).select(*ITEM)


def answers(judged: DataFrame, answered: DataFrame, fetched: DataFrame) -> DataFrame:
    """request_id, status, hits, misses and body of every request: vectors in the order asked for, the model, and the tokens
    billed for what this request was the first to ask for."""
    asked = answered.where("not is_hit").groupBy("key").agg(F.min("request_id").alias("request_id"))
    billed = fetched.join(asked, "key").groupBy("request_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("total_tokens").alias("total_tokens"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("item", "vector"))), lambda x: F.struct(F.lit("embedding").alias("object"), x["vector"].alias("embedding"), x["item"].alias("index")))
    each = answered.groupBy("request_id").agg(data.alias("data"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    none = F.array().cast("array<struct<object: string, embedding: array<float>, index: int>>")
    whole = judged.select("request_id", "status", "model").join(each, "request_id", "left").join(billed, "request_id", "left")
    tokens = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt_tokens", "total_tokens")))
    body = F.to_json(F.struct(F.lit("list").alias("object"), F.coalesce("data", none).alias("data"), "model", tokens.alias("usage")))
    fine = F.col("status") == 200
    error = F.to_json(F.struct(F.concat(F.lit("status "), F.col("status").cast("string")).alias("error")))
    return whole.select("request_id", "status", F.when(fine, F.coalesce("hits", F.lit(0))).alias("hits"), F.when(fine, F.coalesce("misses", F.lit(0))).alias("misses"), F.when(fine, body).otherwise(error).alias("body"))


def deletions(judged: DataFrame, config: Config, images: bool = False) -> DataFrame:
    """The keys that the requests to delete name, as a request to embed would derive them; no provider is called."""
    return items(judged, config, images).select("request_id", "item", "key")


def delete_answers(judged: DataFrame, gone: DataFrame) -> DataFrame:
    """request_id, status and body: how many keys were asked to go, there or not."""
    n = gone.groupBy("request_id").agg(F.count("*").alias("deleted"))
    both = judged.select("request_id", "status").join(n, "request_id", "left")
    fine = F.to_json(F.struct(F.coalesce("deleted", F.lit(0)).alias("deleted")))
    error = F.to_json(F.struct(F.concat(F.lit("status "), F.col("status").cast("string")).alias("error")))
    return both.select("request_id", "status", F.when(F.col("status") == 200, fine).otherwise(error).alias("body"))
