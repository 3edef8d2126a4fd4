"""Queries over the request path, the provider wires, images, usage, counters and compositions, with SQL for each.

Conversations are requests (a turn is a position of the input), pages are images, documents are items of providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import keys, wire
from .operators import memo, metrics, retrieval
from .plans import compositions, engine, requests
from .queries import _ITEMS, _NORM, _VEC, _items, _t
from .sources import codecs
from .sources.providers import Stub, WireProvider, hash_vector, usage
from .sources.store import Store
from .sources.wires import Reply
from .streaming import stream
from .tables import new_path, written

CONFIG = Config(azure_foundry_base_url="https://foundry.example", azure_openai_base_url="https://azure.example", vertex_project="p1")
#: provider and model of a request by conv_id % 10; nobody is not registered, the last model means nothing to its provider.
ROUTES = (
    ("openai", "e-1"), ("mistral", "e-2"), ("gemini", "e-3"), ("huggingface", "e-4"), ("bedrock", "amazon.titan-embed-text-v2:0"), ("bedrock", "cohere.embed-english-v3"),
    ("vertexai", "text-embedding-005"), ("azure", "foundry:e-5#query"), ("nobody", "e-6"), ("vertexai", "a/b"),
)
#: Providers that tell tokens.
TELLING = ("openai", "mistral", "titan", "vertexai", "azure")


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _frames(s: SparkSession, d: str, images: bool = False) -> DataFrame:
    """request_id, provider, authorization and body; every 13th has no bearer token, every 17th a broken body, every 19th a
    number for input."""
    if images:
        p = _t(s, d, "pages").select((F.col("page_id") % 100).alias("request_id"), F.floor(F.col("page_id") / 100).alias("turn"), F.substring("url", 1, 30).alias("url"))
        uri = F.when((F.col("request_id") == 7) & (F.col("turn") == 0), F.col("url")).otherwise(wire.format_data_uri(F.lit("image/png"), keys.base64_line(F.encode("url", "utf-8"))))
        own = p.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", uri.alias("x")))), lambda x: x["x"]).alias("input"))
        own = own.withColumn("provider", F.when(F.col("request_id") % 10 == 3, "openai").otherwise("gemini")).withColumn("model", F.lit("g-1"))
    else:
        own = _t(s, d, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("input"))
        own = own.withColumn("provider", _pick(tuple(p for p, _ in ROUTES), F.col("request_id"))).withColumn("model", _pick(tuple(m for _, m in ROUTES), F.col("request_id")))
    i = F.col("request_id")
    body = F.when(i % 17 == 16, "{").when(i % 19 == 18, F.to_json(F.struct("model", F.lit(5).alias("input")))).otherwise(F.to_json(F.struct("model", "input")))
    token = F.when(i % 13 == 12, F.lit("Basic x")).otherwise(F.concat(F.lit("Bearer sk-"), (i % 3).cast("string")))
    return own.select(i, "provider", token.alias("authorization"), body.alias("body"))


def _flow(s: SparkSession, d: str, images: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests judged, items answered and vectors fetched: first the even requests, then, over the same store, all."""
    at = new_path(s, "flow")
    seen = requests.judged(_frames(s, d, images), CONFIG, images).persist()
    items = requests.items(seen, CONFIG, images).persist()  # not written: they carry the credential
    store, provider = Store(s, f"{at}/log"), WireProvider(Stub())
    engine.billed(items.where("request_id % 2 = 0"), store, provider, 1, order="place", at=f"{at}/1")
    done, fetched = engine.billed(items, store, provider, 2, order="place", at=f"{at}/2")
    return seen, written(done.drop("api_key"), f"{at}/answered"), fetched


def request_judgement(s, d):
    return requests.judged(_frames(s, d), CONFIG).select("request_id", "status")


def request_scopes(s, d):
    items = requests.items(requests.judged(_frames(s, d), CONFIG), CONFIG)
    return items.select("provider", "model", F.replace("scope", F.lit("\0"), F.lit("|")).alias("scope"), "strategy", "endpoint", "model_id", "qualifier", "max_batch").distinct()


def _answers(s, d, images):
    out = requests.answers(*_flow(s, d, images))
    tokens = F.get_json_object("body", "$.usage.total_tokens").cast("long")
    data = F.from_json(F.get_json_object("body", "$.data"), "array<struct<index: long, embedding: array<double>>>")
    return out.select("request_id", "status", "hits", "misses", tokens.alias("tokens"), F.size(data).cast("long").alias("n"), F.round(F.aggregate(data, F.lit(0.0), lambda a, x: a + x["embedding"][0] * (x["index"] + 1)), 4).alias("first"), F.get_json_object("body", "$.model").alias("model"))


def request_answers(s, d):
    return _answers(s, d, False)


def image_answers(s, d):
    return _answers(s, d, True)


def provider_calls(s, d):
    items = _items(s, d).withColumns({"model": F.lit("m"), "strategy": _pick(("openai", "titan", "cohere", "vertex", "gemini", "huggingface", "foundry"), F.col("item")), "api_key": F.lit("k"), "qualifier": F.lit("search_document")})
    size = F.when(F.col("strategy") == "titan", 1).when(F.col("strategy") == "cohere", 96).when(F.col("strategy") == "vertex", 250).otherwise(100)
    items = items.withColumns({"key": F.sha2(F.concat_ws("|", "strategy", "text"), 256), "provider": F.col("strategy"), "max_batch": size})
    none = items.select("key", F.array().cast("array<float>").alias("vector")).limit(0)
    done, fetched = engine.embed_items(items, none, WireProvider(Stub()))
    named = done.groupBy("key").agg(F.first("provider").alias("provider"), F.first(F.round(F.col("vector")[0].cast("double"), 6)).alias("v0"))
    return usage(fetched.join(named, "key"), "provider").join(named.groupBy("provider").agg(F.round(F.sum("v0"), 3).alias("v0")), "provider")


def counters(s, d):
    _, done, fetched = _flow(s, d)
    who = done.where("not is_hit").groupBy("key").agg(F.first("provider").alias("provider"), F.first("content_type").alias("content_type"))
    return metrics.counters(done, fetched.join(who, "key"))


def _scrapes(s, d):
    """Lines of two scrapes: hits and misses of events by type and day parity, first the first half of them, then all."""
    e = _t(s, d, "events").select("event_id", F.col("event_type").alias("provider"), F.when(F.col("user_id") % 2 == 0, "text").otherwise("image").alias("content_type"), (F.col("event_id") % 3 == 0).alias("is_hit"))
    both = [e.where("event_id % 2 = 0").withColumn("scrape", F.lit(0)), e.withColumn("scrape", F.lit(1))]
    return [metrics.metrics_text(memo.stats(x, "provider", "content_type")).select(F.lit(i).alias("scrape"), "value") for i, x in enumerate(both)]


def metric_sums(s, d):
    _, after = _scrapes(s, d)
    each = [metrics.sum_metric(after, f, **labels).withColumn("i", F.lit(i)) for i, (f, labels) in enumerate((("memo_hits_total", {}), ("memo_misses_total", {"content_type": "image"}), ("memo_hits_total", {"provider": "purchase", "content_type": "text"}), ("memo_none_total", {})))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def metric_deltas(s, d):
    lines = _scrapes(s, d)
    rows = [metrics.parsed(x).withColumn("scrape", F.lit(i)) for i, x in enumerate(lines)]
    return metrics.delta(rows[0].unionByName(rows[1])).where("scrape = 1").groupBy("family").agg(F.sum("increase").alias("increase"))


def check_tally(s, d):
    c = _t(s, d, "conversations")
    return metrics.tally(c.select((F.length("text") > 100).alias("ok")))


def first_places(s, d):
    c = _t(s, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("item"), F.md5(F.substring("text", 1, 3)).alias("key"), F.lit(False).alias("is_hit"))
    return memo.first_places(c).select("request_id", "item", F.col("unique_index").cast("long").alias("unique_index"))


def stored_values(s, d):
    e = _t(s, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, 1706659200 + F.col("vec_id")).alias("expires_at"))
    both = e.withColumns({"value": codecs.encode_value("embedding", "expires_at"), "plain": codecs.encode_vector("embedding")})
    out = both.select("vec_id", "value", "plain", codecs.decode_value("value").alias("back"), codecs.decode_vector(F.concat("plain", F.lit(b"x"))).alias("floats"))
    same = F.col("floats") == F.col("back.vector")
    return out.select("vec_id", F.col("back.expires_at").alias("expires_at"), F.octet_length("value").cast("long").alias("bytes"), F.hex(F.substring("value", 1, 8)).alias("head"), F.round(F.aggregate("floats", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), (same & (F.substring("value", 9, 1 << 20) == F.col("plain"))).alias("same"))


def prefixed_keys(s, d):
    return _items(s, d).select("item", F.hex(codecs.prefixed(F.col("key"))).alias("stored"))


def delete_requests(s, d):
    at = new_path(s, "delete")
    seen = requests.judged(_frames(s, d), CONFIG)
    store = Store(s, f"{at}/log")
    engine.run(requests.items(seen, CONFIG), store, WireProvider(Stub()), 1, order="place", at=f"{at}/1")
    gone = requests.judged(_frames(s, d).where("request_id % 5 < 2"), CONFIG)
    names = written(requests.deletions(gone, CONFIG), f"{at}/gone")
    store.delete(names, 2)
    left = requests.items(seen, CONFIG).join(store.lookup().select("key", F.lit(1).alias("there")), "key", "left").groupBy("request_id").agg(F.count("there").alias("there"))
    told = requests.delete_answers(gone, names).select("request_id", F.get_json_object("body", "$.deleted").cast("long").alias("deleted"))
    return left.join(told, "request_id", "left")


def stream_embed(s, d):
    tmp = new_path(s, "stream")
    items = _items(s, d).withColumn("model", F.lit("m"))
    items = items.withColumn("strategy", F.lit("openai"))
    store, provider = Store(s, f"{tmp}/log"), WireProvider(Stub())
    for part in (0, 1):  # two arrivals, one after the other
        items.where(F.col("item") % 2 == part).write.mode("append").parquet(f"{tmp}/in")
        source = s.readStream.schema(items.schema).parquet(f"{tmp}/in")
        stream.embed_stream(source, store, provider, f"{tmp}/out", f"{tmp}/check").awaitTermination()
    return s.read.parquet(f"{tmp}/out").select("item", "is_hit", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"))


def duplicate_texts(s, d):
    c = _t(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    at = new_path(s, "duplicates")
    return compositions.duplicates(c, Store(s, f"{at}/log"), _plain(), 1, 0.6, f"{at}/1").select("a", "b", F.round("sim", 6).alias("sim"))


def chunk_answers(s, d):
    at = new_path(s, "rag")
    store = Store(s, f"{at}/log")
    index = written(compositions.indexed_chunks(_t(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), store, _plain(), 1, at=f"{at}/1"), f"{at}/index")
    asked = _t(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    return compositions.asked(asked, index, store, _plain(), 2, 2, f"{at}/2").select("query_id", "rank", F.round("sim", 6).alias("sim"))


def kind_search(s, d):
    e = _t(s, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "text").otherwise("image").alias("kind"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.top_k(q, retrieval.of_kind(e, "image"), 2)
    top = retrieval.best(found.select("query_id", "vec_id", "sim"), "query_id")
    names = retrieval.union_of(found, "query_id", "vec_id").select("query_id", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("found"))
    return top.join(names, "query_id").select("query_id", "vec_id", F.round("sim", 6).alias("sim"), "found")


def primed_keys(s, d):
    old = _t(s, d, "documents").select(F.sha2("text", 256).alias("key"))
    new = _t(s, d, "documents").select(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("key"))
    kept = old.intersect(new).count()
    return compositions.primed(old, new).agg(F.count("*").alias("keys")).withColumn("kept", F.lit(kept).cast("long"))


def settings(s, d):
    """Defaults, authentication modes, mime types and failures by the columns that a request may carry."""
    e = _t(s, d, "events").select("event_type").distinct()
    v = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "purchase", "api-key").otherwise(F.col("event_type"))
    file = F.concat("event_type", F.when(F.length("event_type") % 2 == 0, ".PNG").otherwise(".jpeg"))
    kind = F.when(F.length("event_type") % 3 == 0, "provider").when(F.length("event_type") % 3 == 1, "store")
    return e.select("event_type", wire.or_default(v, "fallback").alias("value"), wire.auth_mode(v).alias("mode"), wire.mime_type(file).alias("mime"), wire.failure(kind).alias("status"))


class _Plain:
    """Hash vectors without a wire, centred so that unrelated texts are not alike."""

    version = "1"

    def embed(self, key, strategy, to, inputs):
        return Reply([[x - 0.5 for x in hash_vector(t)] for t in inputs], len(inputs), len(inputs))


def _plain() -> _Plain:
    return _Plain()


_NAMES = "request_judgement request_scopes request_answers image_answers provider_calls counters metric_sums metric_deltas check_tally first_places stored_values prefixed_keys delete_requests stream_embed duplicate_texts chunk_answers kind_search primed_keys settings".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}


def _sql_pick(values: tuple, by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


_PROVIDER, _MODEL = _sql_pick(tuple(p for p, _ in ROUTES), "conv_id"), _sql_pick(tuple(m for _, m in ROUTES), "conv_id")
_BASES = "CASE provider WHEN 'openai' THEN 'https://api.openai.com' WHEN 'mistral' THEN 'https://api.mistral.ai' WHEN 'gemini' THEN 'https://generativelanguage.googleapis.com' WHEN 'huggingface' THEN 'https://router.huggingface.co/hf-inference' END"
_R = f"r AS (SELECT conv_id AS request_id, {_PROVIDER} AS provider, {_MODEL} AS model, turn, {_NORM} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item, CASE WHEN conv_id % 17 = 16 THEN 400 WHEN conv_id % 19 = 18 THEN 422 WHEN conv_id % 13 = 12 THEN 401 WHEN conv_id % 10 = 8 THEN 404 WHEN conv_id % 10 = 9 THEN 502 ELSE 200 END AS status FROM conversations), x AS (SELECT *, provider || '|' || model || '|' || (request_id % 3)::VARCHAR || '|' || text AS key, sha256(text) AS h FROM r WHERE status = 200)"
_I = "p AS (SELECT page_id % 100 AS request_id, page_id // 100 AS turn, substr(url, 1, 30) AS url FROM pages), r AS (SELECT *, CASE WHEN request_id % 10 = 3 THEN 'openai' ELSE 'gemini' END AS provider, 'g-1' AS model, row_number() OVER (PARTITION BY request_id ORDER BY turn) - 1 AS item, CASE WHEN request_id % 17 = 16 THEN 400 WHEN request_id % 19 = 18 THEN 422 WHEN request_id % 13 = 12 THEN 401 WHEN request_id % 10 = 3 THEN 404 WHEN request_id = 7 THEN 400 ELSE 200 END AS status FROM p), x AS (SELECT *, (request_id % 3)::VARCHAR || '|' || url AS key, sha256(to_base64(encode(url))) AS h, '' AS text FROM r WHERE status = 200)"
_TELLS = "CASE WHEN provider IN ('openai', 'mistral', 'vertexai', 'azure') OR model LIKE 'amazon%' THEN len(string_split(text, ' ')) ELSE 0 END"
_DONE = "s AS (SELECT DISTINCT key FROM x WHERE request_id % 2 = 0), y AS (SELECT x.*, s.key IS NOT NULL AS is_hit FROM x LEFT JOIN s ON x.key = s.key), f AS (SELECT *, NOT is_hit AND row_number() OVER (PARTITION BY key ORDER BY request_id, item) = 1 AS fetched FROM y)"


def _sql_answers(rows: str, tokens: str) -> str:
    v0 = "('0x' || substr(h, 1, 4))::BIGINT / 65536.0"
    return f"WITH {rows}, {_DONE}, a AS (SELECT request_id, count(*) FILTER (WHERE is_hit) AS hits, count(*) FILTER (WHERE NOT is_hit) AS misses, sum(CASE WHEN fetched THEN {tokens} ELSE 0 END)::BIGINT AS tokens, count(*) AS n, round(sum({v0} * (item + 1)), 4) AS first FROM f GROUP BY request_id), q AS (SELECT DISTINCT request_id, status, model FROM r) SELECT q.request_id, q.status, a.hits, a.misses, a.tokens, coalesce(a.n, NULL) AS n, a.first, CASE WHEN q.status = 200 THEN q.model END AS model FROM q LEFT JOIN a USING (request_id)"


def oracle_sql() -> dict[str, str]:
    strategies = _sql_pick(("openai", "titan", "cohere", "vertex", "gemini", "huggingface", "foundry"), "item")
    scrapes = "e AS (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'text' ELSE 'image' END AS c, event_id % 3 = 0 AS hit FROM events)"
    centred = _VEC.replace("/ 65536.0)", "/ 65536.0 - 0.5)")
    real = "list_transform(embedding, lambda v: v::DOUBLE)"
    return {
        "request_judgement": f"WITH {_R} SELECT DISTINCT request_id, status FROM r",
        "request_scopes": f"WITH {_R}, k AS (SELECT DISTINCT provider, model FROM x), m AS (SELECT *, CASE WHEN provider = 'bedrock' THEN 'https://bedrock-runtime.us-east-1.amazonaws.com' WHEN provider = 'vertexai' THEN 'https://us-central1-aiplatform.googleapis.com/v1/projects/p1/locations/us-central1/publishers/google/models' WHEN provider = 'azure' THEN 'https://foundry.example/models/embeddings?api-version=2024-05-01-preview' ELSE {_BASES} END AS endpoint, CASE WHEN provider = 'bedrock' THEN 'us-east-1/' || model || CASE WHEN model LIKE 'cohere%' THEN '#search_document' ELSE '' END WHEN provider = 'vertexai' THEN 'us-central1/p1/' || model WHEN provider = 'azure' THEN 'foundry:e-5@2024-05-01-preview#query' END AS canonical FROM k) SELECT provider, model, CASE WHEN canonical IS NULL THEN endpoint ELSE endpoint || '|' || canonical || '|kit1' END AS scope, CASE provider WHEN 'bedrock' THEN CASE WHEN model LIKE 'cohere%' THEN 'cohere' ELSE 'titan' END WHEN 'vertexai' THEN 'vertex' WHEN 'azure' THEN 'foundry' ELSE provider END AS strategy, endpoint, CASE WHEN provider = 'azure' THEN 'e-5' ELSE model END AS model_id, CASE WHEN model LIKE 'cohere%' THEN 'search_document' WHEN provider = 'azure' THEN 'query' END AS qualifier, CASE WHEN provider = 'vertexai' THEN 250 WHEN model LIKE 'cohere%' THEN 96 WHEN model LIKE 'amazon%' THEN 1 ELSE 100 END AS max_batch FROM m",
        "request_answers": _sql_answers(_R, _TELLS),
        "image_answers": _sql_answers(_I, "0"),
        "provider_calls": f"WITH {_ITEMS}, u AS (SELECT {strategies} AS provider, text FROM items), k AS (SELECT provider, count(*) AS n, sum(CASE WHEN provider IN ('openai', 'titan', 'vertex', 'foundry') THEN len(string_split(text, ' ')) ELSE 0 END)::BIGINT AS tokens, round(sum(round((('0x' || substr(sha256(text), 1, 4))::BIGINT / 65536.0)::DOUBLE, 6)), 3) AS v0 FROM (SELECT DISTINCT provider, text FROM u) GROUP BY provider) SELECT provider, ceil(n / (CASE provider WHEN 'titan' THEN 1 WHEN 'cohere' THEN 96 WHEN 'vertex' THEN 250 ELSE 100 END))::BIGINT AS calls, n AS inputs, tokens AS prompt_tokens, tokens AS total_tokens, v0 FROM k",
        "counters": f"WITH {_R}, {_DONE} SELECT provider, 'text' AS content_type, count(*) FILTER (WHERE is_hit) AS hits, count(*) FILTER (WHERE NOT is_hit) AS misses, sum(CASE WHEN fetched THEN {_TELLS} ELSE 0 END)::BIGINT AS prompt_tokens FROM f GROUP BY provider",
        "metric_sums": f"WITH {scrapes} SELECT 0 AS i, count(*) FILTER (WHERE hit)::DOUBLE AS total FROM e UNION ALL SELECT 1, count(*) FILTER (WHERE NOT hit AND c = 'image')::DOUBLE FROM e UNION ALL SELECT 2, count(*) FILTER (WHERE hit AND event_type = 'purchase' AND c = 'text')::DOUBLE FROM e UNION ALL SELECT 3, 0.0::DOUBLE",
        "metric_deltas": f"WITH {scrapes}, n AS (SELECT hit, count(*) FILTER (WHERE event_id % 2 = 1)::DOUBLE AS increase FROM e GROUP BY hit) SELECT CASE WHEN hit THEN 'memo_hits_total' ELSE 'memo_misses_total' END AS family, increase FROM n",
        "check_tally": "SELECT count(*) FILTER (WHERE length(text) > 100) AS passed, count(*) FILTER (WHERE length(text) <= 100) AS failed FROM conversations",
        "first_places": "WITH k AS (SELECT conv_id AS request_id, turn AS item, substr(text, 1, 3) AS key FROM conversations), m AS (SELECT *, min(item) OVER (PARTITION BY request_id, key) AS first FROM k) SELECT request_id, item, dense_rank() OVER (PARTITION BY request_id ORDER BY first) - 1 AS unique_index FROM m",
        "stored_values": f"WITH e AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1706659200 + vec_id END AS expires_at, embedding FROM embeddings), b AS (SELECT *, printf('%016x', coalesce(expires_at, 0)) AS x FROM e) SELECT vec_id, expires_at, 8 + 4 * len(embedding) AS bytes, upper(substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)) AS head, round(list_sum({real}), 5) AS total, true AS same FROM b",
        "prefixed_keys": f"WITH {_ITEMS} SELECT item, hex('embermill:') || upper(key) AS stored FROM items",
        "delete_requests": f"WITH {_R}, g AS (SELECT DISTINCT key FROM x WHERE request_id % 5 < 2) SELECT x.request_id, count(*) FILTER (WHERE g.key IS NULL) AS there, CASE WHEN x.request_id % 5 < 2 THEN count(*) END AS deleted FROM x LEFT JOIN g ON x.key = g.key GROUP BY x.request_id",
        "stream_embed": f"WITH d AS (SELECT doc_id AS item, {_NORM} AS n, source, lang, doc_id % 7 AS o FROM documents), s AS (SELECT DISTINCT n, source, lang, o FROM d WHERE item % 2 = 0) SELECT d.item, d.item % 2 = 1 AND s.n IS NOT NULL AS is_hit, round((('0x' || substr(sha256(d.n), 1, 4))::BIGINT / 65536.0)::DOUBLE, 6) AS v0 FROM d LEFT JOIN s ON d.n = s.n AND d.source = s.source AND d.lang = s.lang AND d.o = s.o",
        "duplicate_texts": f"WITH c AS (SELECT conv_id * 100 + turn AS id, sha256({_NORM}) AS h FROM conversations), v AS (SELECT id, {centred} AS v FROM c), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS sim FROM v x JOIN v y ON x.id < y.id) SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.6",
        "chunk_answers": f"WITH b AS (SELECT item_id, text, greatest(ceil((length(text) - 20) / 180.0)::BIGINT, 1) AS k FROM benchmark), x AS (SELECT item_id, text, unnest(range(0, k)) AS i FROM b), z AS (SELECT item_id, i, substr(text, i * 180 + 1, 200) AS text FROM x), n AS (SELECT sha256({_NORM}) AS h FROM z), v AS (SELECT {centred} AS v FROM n), q AS (SELECT conv_id AS query_id, sha256({_NORM}) AS h FROM conversations WHERE turn = 0), w AS (SELECT query_id, {centred} AS v FROM q), s AS (SELECT query_id, list_cosine_similarity(w.v, v.v) AS sim FROM w CROSS JOIN v), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC) AS rank, round(sim, 6) AS sim FROM s) SELECT * FROM r WHERE rank <= 2",
        "kind_search": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, min(vec_id) FILTER (WHERE rank = 1) AS vec_id, round(max(sim), 6) AS sim, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS found FROM r WHERE rank <= 2 GROUP BY query_id",
        "primed_keys": "WITH o AS (SELECT DISTINCT text AS k FROM documents), n AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS k FROM documents) SELECT (SELECT count(*) FROM (SELECT k FROM o UNION SELECT k FROM n)) AS keys, (SELECT count(*) FROM (SELECT k FROM o INTERSECT SELECT k FROM n)) AS kept",
        "settings": "SELECT DISTINCT event_type, CASE WHEN event_type = 'click' THEN 'fallback' WHEN event_type = 'purchase' THEN 'api-key' ELSE event_type END AS value, CASE WHEN event_type = 'purchase' THEN 'api-key' ELSE 'bearer' END AS mode, CASE WHEN length(event_type) % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, CASE length(event_type) % 3 WHEN 0 THEN 502 WHEN 1 THEN 500 END AS status FROM events",
    }
