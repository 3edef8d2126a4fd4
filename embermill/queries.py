"""Queries over the driver's tables for every operator, with SQL that gives the same rows.

documents are items (source: provider, lang: model), conversations are requests (conv_id, turn), events are a request log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, models, wire
from .operators import memo, metrics, retrieval
from .plans import compositions, engine
from .sources import store as stores
from .sources.providers import HashProvider, embed
from .streaming import stream
from .tables import new_path

NOW = 1706659200
_WS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _key(text: Column, owner: Column) -> Column:
    return keys.text_key(owner, F.col("source"), F.concat(F.lit("https://"), F.col("source")), F.col("lang"), F.lit("1"), text)


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", keys.normalize_text(F.col("text")).alias("text"))
    owner = keys.owner_id(F.concat(F.lit("sk-"), (F.col("doc_id") % 7).cast("string")))
    return docs.select(F.col("doc_id").alias("item"), F.col("source").alias("provider"), F.col("lang").alias("model"), "text", _key(F.col("text"), owner).alias("key"), owner.alias("owner"))


def _vector(text: Column) -> Column:
    return _numbers(F.sha2(text, 256))


def _numbers(h: Column) -> Column:
    return F.array(*((F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("double") / 65536).cast("float") for i in range(16)))


def _seeded(items: DataFrame) -> DataFrame:
    # digests are made where the texts are read; only key and digest are shuffled
    own = items.where("item % 2 = 0").select("key", F.sha2("text", 256).alias("digest"))
    return own.groupBy("key").agg(F.first("digest").alias("digest")).select("key", _numbers(F.col("digest")).alias("vector"))


def _f(x: str) -> str:
    return f"strlen({x})::VARCHAR || ':' || {x}"


_NORM = f"trim(regexp_replace(text, '{_WS}', ' ', 'g'))"
_OWNER = "sha256('sk-' || (doc_id % 7)::VARCHAR)"


def _sqlkey(text: str = "n", owner: str = "owner") -> str:
    return "sha256(" + " || ".join(_f(x) for x in ("'text'", owner, "source", "('https://' || source)", "lang", "'1'", text)) + ")"


_ITEMS = f"d AS (SELECT doc_id, source, lang, {_NORM} AS n, {_OWNER} AS owner FROM documents), items AS (SELECT doc_id AS item, source AS provider, lang AS model, n AS text, {_sqlkey()} AS key, owner FROM d), store AS (SELECT DISTINCT key FROM items WHERE item % 2 = 0), rec AS (SELECT i.*, s.key IS NOT NULL AS is_hit FROM items i LEFT JOIN store s ON i.key = s.key)"
_LOG = "e AS (SELECT event_id, user_id, event_type, sha256(props) AS key, floor(epoch(ts))::BIGINT AS t FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", F.sha2("props", 256).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))


def normalize_documents(s, d):
    return _t(s, d, "documents").select("doc_id", keys.normalize_text(F.col("text")).alias("normalized"))


def owner_ids(s, d):
    return _t(s, d, "events").select("user_id").distinct().select("user_id", keys.owner_id(F.concat(F.lit("sk-"), F.col("user_id").cast("string"))).alias("owner"))


def text_cache_keys(s, d):
    return _items(s, d).select("item", "key")


def image_cache_keys(s, d):
    uri = wire.format_data_uri(F.lit("image/png"), keys.base64_line(F.encode("html", "utf-8")))
    image = wire.data_uri(uri)
    p = _t(s, d, "pages").select("page_id", image.alias("image"))
    lits = [F.lit(x) for x in ("o", "gemini", "https://gemini", "m", "1")]
    return p.select("page_id", keys.image_key(*lits, F.col("image.mime"), F.col("image.data")).alias("key"))


def domain_separation(s, d):
    o = [F.lit(x) for x in ("o", "p", "s")]
    cases = s.range(1).select(F.posexplode(F.array(
        keys.text_key(*o, F.lit("m\0V"), F.lit("V"), F.lit("x")), keys.text_key(*o, F.lit("m"), F.lit("V"), F.lit("V\0x")),
        keys.text_key(*o, F.lit("m"), F.lit("V"), F.lit("image\0image/png\0YmFz")), keys.image_key(*o, F.lit("m"), F.lit("V"), F.lit("image/png"), F.lit("YmFz")),
        keys.text_key(*o, F.lit("gpt"), F.lit("4-embed"), F.lit("x")), keys.text_key(*o, F.lit("gpt-4"), F.lit("embed"), F.lit("x")))).alias("i", "key"))
    return cases.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("key")).alias("collisions"))


def reconcile_documents(s, d):
    items = _items(s, d)
    return memo.reconcile(items, _seeded(items)).select("item", "key", "is_hit")


def hit_miss_by_source(s, d):
    items = _items(s, d)
    return memo.stats(memo.reconcile(items, _seeded(items)), "provider")


def unique_misses(s, d):
    items = _items(s, d)
    return memo.unique_misses(memo.reconcile(items, _seeded(items))).select("key", "first_item", "n_items", F.octet_length("text").cast("long").alias("bytes"))


def provider_chunks(s, d):
    u = _items(s, d)
    u = memo.reconcile(u, _seeded(u)).where("not is_hit").groupBy("key").agg(F.min("item").alias("first_item"), F.min("provider").alias("provider"))
    return memo.chunks(u, 96).select("key", "provider", "chunk", "position")


def embed_documents(s, d):
    items = _items(s, d)
    out, _ = engine.embed_items(items, _seeded(items), HashProvider())
    return out.select("item", "is_hit", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def embed_twice_stats(s, d):
    items = _items(s, d)
    once = embed(engine.missing(memo.reconcile(items, _seeded(items).limit(0))), HashProvider())
    first = memo.stats(memo.reconcile(items, _seeded(items).limit(0)).withColumn("pass", F.lit(1)), "pass")
    second = memo.stats(memo.reconcile(items, once).withColumn("pass", F.lit(2)), "pass")
    return first.unionByName(second)


def claims(s, d):
    e = _events(s, d).select("key", F.col("t").alias("ts"), F.col("event_id").alias("request_id"))
    return memo.claims(e).select("request_id", "claimed")


def usage_by_request(s, d):
    c = _t(s, d, "conversations").select("conv_id", "turn", keys.normalize_text(F.col("text")).alias("text")).withColumn("key", F.sha2("text", 256))
    billed = memo.claims(c.select("key", F.col("conv_id").alias("ts"), F.col("turn").alias("request_id"), "text")).groupBy(F.col("ts").alias("conv_id"))
    return billed.agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("claimed"), F.size(F.split("text", " "))).otherwise(0)).cast("long").alias("tokens"))


def metrics_by_provider(s, d):
    items = _items(s, d)
    return memo.stats(memo.reconcile(items, _seeded(items)).withColumn("content_type", F.lit("text")), "provider").select(F.lit("text").alias("content_type"), "provider", "hits", "misses")


def metrics_lines(s, d):
    return metrics.metrics_text(metrics_by_provider(s, d))


def _log(s, d):
    e = _events(s, d)
    return e.select("key", F.when(F.col("event_type") == "purchase", "del").otherwise("put").alias("op"), F.array(F.lit(0.5).cast("float")).alias("vector"), F.when(F.col("user_id") % 2 == 0, F.col("t") + 86400).alias("expires_at"), F.col("event_id").alias("seq"))


def last_write_wins(s, d):
    return stores.latest(_log(s, d)).select("key", "expires_at")


def ttl_lookup(s, d):
    return stores.latest(_log(s, d), NOW).select("key")


def delete_keys(s, d):
    log, gone = _log(s, d), _t(s, d, "events").where("event_id % 3 = 0").select(F.sha2("props", 256).alias("key"))
    tombs = gone.select("key", F.lit("del").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("long").alias("expires_at"), F.lit(1 << 40).alias("seq"))
    return stores.latest(log.unionByName(tombs)).agg(F.count("*").alias("left_over")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("deleted"))))


def owner_isolation(s, d):
    i = _items(s, d)
    return i.groupBy("key").agg(F.countDistinct("owner").alias("o")).agg(F.count("*").alias("n_keys"), F.count_if(F.col("o") > 1).alias("shared"))


BODIES = ('{"model":"m","input":["a","b"]}', '{"x":{"input":"s"},"model":"m","input":["a","b"]}', '{"model":"m","x":"\\"input\\":\\"s\\"","input":["a",null]}', '{"model":7,"input":"a"}', '{"model":"m","x":{"input":"s"}}', '[1]', '{"model":"m","input":"just one string"}', '{"model":"m","input":[1,2,3]}', '{"model":"m","input":[]}', '{"input":["a"]}', "{broken")
HEADERS = ("Bearer sk-1", "bearer sk-1", "Basic x", "Bearer ", None)
BEDROCK = ("amazon.titan-embed-text-v2:0", "eu-west-1/cohere.embed-english-v3#search_query", "cohere.embed-english-v3", "", "/cohere.embed-english-v3", "us-east-1/", "cohere.embed-english-v3#", "amazon.titan-embed-text-v2:0#x", "us-east-1/cohere.embed-x/evil", "@169.254.169.254?/cohere.embed-x", "us-east-1\n/cohere.embed-x", "\nus-east-1/cohere.embed-x", "US-EAST-1/cohere.embed-x", "openai.embed")
VERTEX = ("text-embedding-005", "us-central1/my-project/text-embedding-005", "global/p1/text-embedding-005", "eu/p1/gemini-embedding-001#RETRIEVAL_QUERY", "", "my-project/text-embedding-005", "a/b/c/d", "us-central1//text-embedding-005", "text-embedding-005#", "us-central1/my.proj:x/text-embedding-005", "us-central1\n/p1/text-embedding-005", "us-central1/p1\n/text-embedding-005", "us/p-1/gemini-embedding-001", "us-central1/p1/text?x", "us-central1/p1/")
AZURE = ("text-embedding-3-small", "foundry:cohere-embed-v3-english", "foundry:cohere-embed-v3-english#query", "", "foundry:", "text-embedding-3-small#", "text-embedding-3-small#x")
URIS = ("data:image/png;base64,aGVsbG8=", "image/png;base64,aGVsbG8=", "data:image/png,aGVsbG8=", "data:;base64,aGVsbG8=", "", "data:a;base64,b;base64,c")
TTLS = ("30", "0", "", "abc", "-5", None, "+7", " 9", "99999999999999999999", "30\n", "\n30", "3 0", "007")


def _rows(s, name, values):
    return s.range(1).select(F.posexplode(F.array(*(F.lit(v).cast("string") for v in values))).alias("i", name))


def _values(name, values):
    return f"v(i, {name}) AS (VALUES " + ", ".join(f"({i}, " + ("NULL" if x is None else "'" + x.replace("'", "''") + "'") + ")" for i, x in enumerate(values)) + ")"


def wire_input(s, d):
    return _rows(s, "body", BODIES).select("i", F.array_join(wire.input_texts(F.col("body")), "|").alias("texts"))


def bearer_tokens(s, d):
    return _rows(s, "header", HEADERS).select("i", wire.bearer_token(F.col("header")).alias("token"))


def request_status(s, d):
    b = _rows(s, "body", BODIES)
    body = F.col("body")
    st = wire.status(wire.is_json(body), wire.input_texts(body), wire.model_name(body), F.when(F.col("i") != 1, F.lit("sk")), F.col("i") != 0)
    return b.select("i", st.alias("status"))


def bedrock_models(s, d):
    return _rows(s, "model", BEDROCK).select("i", models.bedrock(F.col("model")).alias("m")).select("i", "m.canonical", "m.strategy", "m.max_batch")


def vertex_models(s, d):
    return _rows(s, "model", VERTEX).select("i", models.vertex(F.col("model")).alias("m")).select("i", "m.canonical", F.regexp_extract("m.endpoint", "^https://([^/]+)", 1).alias("host"), "m.max_batch")


def azure_models(s, d):
    return _rows(s, "model", AZURE).select("i", models.azure(F.col("model")).alias("m")).select("i", "m.canonical", F.col("m.strategy").alias("surface"), "m.max_batch")


def cache_scopes(s, d):
    c = F.sha2(keys.cache_scope(F.concat(F.lit("https://"), F.col("source")), F.col("lang"), F.lit("kit1")), 256)
    return _t(s, d, "documents").select("source", "lang").distinct().select("source", "lang", c.alias("scope"))


def data_uris(s, d):
    return _rows(s, "uri", URIS).select("i", wire.data_uri(F.col("uri")).alias("u")).select("i", "u.mime", "u.data")


def ttl_config(s, d):
    return _rows(s, "ttl", TTLS).select("i", wire.ttl_seconds(F.col("ttl")).alias("seconds"))


def cosine_pairs(s, d):
    return retrieval.near_pairs(_t(s, d, "embeddings"), 0.4).select("a", "b", F.round("sim", 6).alias("sim"))


def topk_similar(s, d):
    e = _t(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k(q, e, 3).select("query_id", "vec_id", "rank", F.round("sim", 6).alias("sim"))


def index_upsert(s, d):
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("seq"), F.lit("text").alias("kind"), "label")
    new = e.where("id % 5 = 0").select((F.col("id") + 3).alias("id"), F.lit(2).alias("seq"), F.lit("image").alias("kind"), "label")
    return retrieval.upsert(e, new).groupBy("kind", "seq").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("labels"))


def corpus_diff(s, d):
    docs = _t(s, d, "documents")
    old = docs.select(F.sha2("text", 256).alias("key"))
    new = docs.select(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")), 256).alias("key")).union(_t(s, d, "benchmark").select(F.sha2("text", 256)))
    return retrieval.diff(old, new).groupBy("change").agg(F.count("*").alias("n"))


def chunk_documents(s, d):
    return retrieval.fixed_chunks(_t(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("piece")).alias("chars"), F.max(F.length("piece")).alias("longest"))


def responses(s, d):
    c = _t(s, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("item"), keys.normalize_text(F.col("text")).alias("text"))
    out = engine.responses(c.withColumn("vector", _vector(F.col("text"))))
    return out.select("request_id", F.size(F.from_json(F.get_json_object("body", "$.data"), "array<struct<index:long>>")).cast("long").alias("n"))


def stream_reconcile(s, d):
    items = _items(s, d)
    tmp = new_path(s, "stream")
    items.write.mode("overwrite").parquet(f"{tmp}/in")
    source = s.readStream.schema(items.schema).parquet(f"{tmp}/in")
    stream.reconcile_stream(source, _seeded(items), f"{tmp}/out", f"{tmp}/check").awaitTermination()
    return s.read.parquet(f"{tmp}/out").select("item", "key", "is_hit")


def file_ingest(s, d):
    ending = F.element_at(F.array(*map(F.lit, ("txt", "md", "png", "jpg", "jpeg", "pdf"))), (F.col("doc_id") % 6 + 1).cast("int"))
    found = _t(s, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ending).alias("file"), F.encode("text", "utf-8").alias("content"))
    return compositions.ingested(found).select("id", "kind", "mime", F.sha2(F.coalesce("text", "data"), 256).alias("content"))


_NAMES = "normalize_documents owner_ids text_cache_keys image_cache_keys domain_separation reconcile_documents hit_miss_by_source unique_misses provider_chunks embed_documents embed_twice_stats claims usage_by_request metrics_by_provider metrics_lines last_write_wins ttl_lookup delete_keys owner_isolation wire_input bearer_tokens request_status bedrock_models vertex_models azure_models cache_scopes data_uris ttl_config cosine_pairs topk_similar index_upsert corpus_diff chunk_documents responses stream_reconcile file_ingest".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}


_PARSED = "j AS (SELECT i, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body END AS b FROM v), t AS (SELECT *, json_type(b, '$.input') AS kind, CASE WHEN json_type(b, '$.model') = 'VARCHAR' THEN json_extract_string(b, '$.model') END AS model, json_extract(b, '$.input[*]') AS each FROM j), parsed AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN [json_extract_string(b, '$.input')] WHEN kind = 'ARRAY' AND len(list_filter(each, lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN json_extract_string(b, '$.input[*]') END AS texts FROM t)"
_HASH = "h AS (SELECT i, strpos(model, '#') > 0 AS has, CASE WHEN strpos(model, '#') > 0 THEN substr(model, 1, strpos(model, '#') - 1) ELSE model END AS head, substr(model, strpos(model, '#') + 1) AS tail FROM v)"
_VEC = "[" + ", ".join(f"(('0x' || substr(h, {4 * i + 1}, 4))::BIGINT / 65536.0)::DOUBLE" for i in range(16)) + "]"
_REC = f"WITH {_ITEMS} "
_LAST = f"WITH {_LOG}, l AS (SELECT key, arg_max(CASE WHEN event_type = 'purchase' THEN 'del' ELSE 'put' END, event_id) AS op, max(event_id) AS m FROM e GROUP BY key), live AS (SELECT l.key, CASE WHEN e.user_id % 2 = 0 THEN e.t + 86400 END AS expires_at FROM l JOIN e ON e.event_id = l.m WHERE l.op = 'put') "
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def oracle_sql() -> dict[str, str]:
    met = "SELECT provider, count(*) FILTER (WHERE is_hit) AS hits, count(*) FILTER (WHERE NOT is_hit) AS misses FROM rec GROUP BY provider"
    img = "sha256(" + " || ".join(_f(x) for x in ("'image'", "'o'", "'gemini'", "'https://gemini'", "'m'", "'1'", "'image/png'", "b")) + ")"
    return {
        "normalize_documents": f"SELECT doc_id, {_NORM} AS normalized FROM documents",
        "owner_ids": "SELECT DISTINCT user_id, sha256('sk-' || user_id::VARCHAR) AS owner FROM events",
        "text_cache_keys": _REC + "SELECT item, key FROM items",
        "image_cache_keys": f"WITH p AS (SELECT page_id, to_base64(encode(html)) AS b FROM pages) SELECT page_id, {img} AS key FROM p",
        "domain_separation": "WITH c(i, f) AS (VALUES (0, ['text', 'o', 'p', 's', 'm' || chr(0) || 'V', 'V', 'x']), (1, ['text', 'o', 'p', 's', 'm', 'V', 'V' || chr(0) || 'x']), (2, ['text', 'o', 'p', 's', 'm', 'V', 'image' || chr(0) || 'image/png' || chr(0) || 'YmFz']), (3, ['image', 'o', 'p', 's', 'm', 'V', 'image/png', 'YmFz']), (4, ['text', 'o', 'p', 's', 'gpt', '4-embed', 'x']), (5, ['text', 'o', 'p', 's', 'gpt-4', 'embed', 'x'])), k AS (SELECT sha256(array_to_string(list_transform(f, lambda x: strlen(x)::VARCHAR || ':' || x), '')) AS key FROM c) SELECT count(*) AS n, count(*) - count(DISTINCT key) AS collisions FROM k",
        "reconcile_documents": _REC + "SELECT item, key, is_hit FROM rec",
        "hit_miss_by_source": _REC + met,
        "unique_misses": _REC + "SELECT key, min(item) AS first_item, count(*) AS n_items, min(strlen(text)) AS bytes FROM rec WHERE NOT is_hit GROUP BY key",
        "provider_chunks": _REC + ", u AS (SELECT key, min(item) AS f, min(provider) AS provider FROM rec WHERE NOT is_hit GROUP BY key), r AS (SELECT key, provider, row_number() OVER (PARTITION BY provider ORDER BY f) - 1 AS n FROM u) SELECT key, provider, n // 96 AS chunk, n % 96 AS position FROM r",
        "embed_documents": _REC + f", x AS (SELECT item, is_hit, sha256(text) AS h FROM rec), y AS (SELECT item, is_hit, {_VEC} AS v FROM x) SELECT item, is_hit, round(v[1], 6) AS v0, round(list_sum(v), 5) AS total FROM y",
        "embed_twice_stats": "SELECT 1 AS pass, 0 AS hits, count(*) AS misses FROM documents UNION ALL SELECT 2, count(*), 0 FROM documents",
        "claims": f"WITH {_LOG} SELECT event_id AS request_id, row_number() OVER (PARTITION BY key ORDER BY t, event_id) = 1 AS claimed FROM e",
        "usage_by_request": f"WITH c AS (SELECT conv_id, turn, {_NORM} AS n FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY conv_id, turn) AS k FROM c) SELECT conv_id, count(*) AS n_items, sum(CASE WHEN k = 1 THEN len(string_split(n, ' ')) ELSE 0 END)::BIGINT AS tokens FROM r GROUP BY conv_id",
        "metrics_by_provider": _REC + "SELECT 'text' AS content_type, * FROM (" + met + ")",
        "metrics_lines": _REC + f", m AS ({met}) SELECT 'memo_hits_total{{content_type=\"text\",provider=\"' || provider || '\"}} ' || hits::VARCHAR AS value FROM m UNION ALL SELECT 'memo_misses_total{{content_type=\"text\",provider=\"' || provider || '\"}} ' || misses::VARCHAR FROM m".replace("{{", "{").replace("}}", "}"),
        "last_write_wins": _LAST + "SELECT key, expires_at FROM live",
        "ttl_lookup": _LAST + f"SELECT key FROM live WHERE expires_at IS NULL OR {NOW} <= expires_at",
        "delete_keys": _LAST + "SELECT (SELECT count(*) FROM live WHERE key NOT IN (SELECT key FROM e WHERE event_id % 3 = 0)) AS left_over, (SELECT count(*) FROM e WHERE event_id % 3 = 0) AS deleted",
        "owner_isolation": _REC + "SELECT count(*) AS n_keys, count(*) FILTER (WHERE o > 1) AS shared FROM (SELECT key, count(DISTINCT owner) AS o FROM items GROUP BY key)",
        "wire_input": f"WITH {_values('body', BODIES)}, {_PARSED} SELECT i, array_to_string(texts, '|') AS texts FROM parsed",
        "bearer_tokens": f"WITH {_values('header', HEADERS)} SELECT i, CASE WHEN starts_with(header, 'Bearer ') THEN substr(header, 8) END AS token FROM v",
        "request_status": f"WITH {_values('body', BODIES)}, {_PARSED} SELECT i, CASE WHEN NOT valid THEN 400 WHEN model IS NULL OR texts IS NULL THEN 422 WHEN i = 1 THEN 401 WHEN i = 0 THEN 404 ELSE 200 END AS status FROM parsed",
        "bedrock_models": f"WITH {_values('model', BEDROCK)}, {_HASH}, p AS (SELECT *, CASE WHEN strpos(head, '/') > 0 THEN split_part(head, '/', 1) ELSE 'us-east-1' END AS place, CASE WHEN strpos(head, '/') > 0 THEN substr(head, strpos(head, '/') + 1) ELSE head END AS id FROM h), q AS (SELECT *, starts_with(id, 'cohere.embed') AS cohere, starts_with(id, 'amazon.titan-embed') AS titan FROM p), ok AS (SELECT *, regexp_full_match(place, '[a-z0-9-]+') AND NOT regexp_matches(id, '[/?#]') AND (cohere OR titan) AND NOT (has AND (tail = '' OR titan)) AS ok FROM q) SELECT i, CASE WHEN ok THEN place || '/' || id || CASE WHEN cohere THEN '#' || CASE WHEN has THEN tail ELSE 'search_document' END ELSE '' END END AS canonical, CASE WHEN ok THEN CASE WHEN cohere THEN 'cohere' ELSE 'titan' END END AS strategy, CASE WHEN ok THEN CASE WHEN cohere THEN 96 ELSE 1 END END AS max_batch FROM ok",
        "vertex_models": f"WITH {_values('model', VERTEX)}, {_HASH}, p AS (SELECT *, string_split(head, '/') AS l FROM h), q AS (SELECT *, len(l) AS n, CASE WHEN len(l) = 3 THEN l[1] ELSE 'us-central1' END AS place, CASE WHEN len(l) = 3 THEN l[2] ELSE 'my-project' END AS project, l[len(l)] AS id FROM p), ok AS (SELECT *, n IN (1, 3) AND regexp_full_match(place, '[a-z0-9-]+') AND regexp_full_match(project, '[a-z0-9-]+') AND id <> '' AND NOT contains(id, '?') AND NOT (has AND tail = '') AS ok FROM q) SELECT i, CASE WHEN ok THEN place || '/' || project || '/' || id || CASE WHEN has THEN '#' || tail ELSE '' END END AS canonical, CASE WHEN ok THEN CASE WHEN place = 'global' THEN 'aiplatform.googleapis.com' WHEN place IN ('us', 'eu') THEN 'aiplatform.' || place || '.rep.googleapis.com' ELSE place || '-aiplatform.googleapis.com' END END AS host, CASE WHEN ok THEN 250 END AS max_batch FROM ok",
        "azure_models": f"WITH {_values('model', AZURE)}, {_HASH}, p AS (SELECT *, starts_with(head, 'foundry:') AS foundry, CASE WHEN starts_with(head, 'foundry:') THEN substr(head, 9) ELSE head END AS id FROM h), ok AS (SELECT *, id <> '' AND NOT (has AND (NOT foundry OR tail = '')) AS ok FROM p) SELECT i, CASE WHEN ok THEN CASE WHEN foundry THEN 'foundry:' || id || '@2024-05-01-preview' ELSE 'openai:' || id END || CASE WHEN has THEN '#' || tail ELSE '' END END AS canonical, CASE WHEN ok THEN CASE WHEN foundry THEN 'foundry' ELSE 'azure_openai' END END AS surface, CASE WHEN ok THEN 100 END AS max_batch FROM ok",
        "cache_scopes": "SELECT DISTINCT source, lang, sha256('https://' || source || chr(0) || lang || chr(0) || 'kit1') AS scope FROM documents",
        "data_uris": f"WITH {_values('uri', URIS)}, p AS (SELECT i, uri, strpos(uri, ';base64,') AS a FROM v) SELECT i, CASE WHEN starts_with(uri, 'data:') AND a > 6 THEN substr(uri, 6, a - 6) END AS mime, CASE WHEN starts_with(uri, 'data:') AND a > 6 THEN substr(uri, a + 8) END AS data FROM p",
        "ttl_config": f"WITH {_values('ttl', TTLS)}, p AS (SELECT i, CASE WHEN regexp_full_match(ttl, '[+]?[0-9]+') THEN TRY_CAST(ttl AS BIGINT) END AS n FROM v) SELECT i, CASE WHEN n > 0 THEN n END AS seconds FROM p",
        "cosine_pairs": f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4",
        "topk_similar": f"WITH x AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank, round(c, 6) AS sim FROM x) SELECT * FROM r WHERE rank <= 3",
        "index_upsert": "WITH o AS (SELECT vec_id AS id, 1 AS seq, 'text' AS kind, label FROM embeddings), n AS (SELECT id + 3 AS id, 2 AS seq, 'image' AS kind, label FROM o WHERE id % 5 = 0), u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)) SELECT kind, seq, count(*) AS n, sum(label)::BIGINT AS labels FROM u GROUP BY kind, seq",
        "corpus_diff": "WITH o AS (SELECT DISTINCT text AS k FROM documents), n AS (SELECT CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS k FROM documents UNION SELECT text FROM benchmark), j AS (SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL OUTER JOIN n ON o.k = n.k) SELECT change, count(*) AS n FROM j GROUP BY change",
        "chunk_documents": "WITH c AS (SELECT doc_id, text, greatest(ceil((length(text) - 20) / 180.0)::BIGINT, 1) AS k FROM documents), x AS (SELECT doc_id, text, unnest(range(0, k)) AS i FROM c), y AS (SELECT doc_id, length(substr(text, i * 180 + 1, 200)) AS n FROM x) SELECT doc_id, count(*) AS n_chunks, sum(n)::BIGINT AS chars, max(n) AS longest FROM y GROUP BY doc_id",
        "responses": "SELECT conv_id AS request_id, count(*) AS n FROM conversations GROUP BY conv_id",
        "stream_reconcile": _REC + "SELECT item, key, is_hit FROM rec",
        "file_ingest": "WITH f AS (SELECT doc_id, ['txt', 'md', 'png', 'jpg', 'jpeg', 'pdf'][doc_id % 6 + 1] AS e, text FROM documents), k AS (SELECT *, 'doc' || doc_id::VARCHAR || '.' || e AS file, CASE WHEN e IN ('txt', 'md') THEN 'text' ELSE 'image' END AS kind FROM f WHERE e <> 'pdf') SELECT kind || ':' || file AS id, kind, CASE WHEN kind = 'image' THEN CASE WHEN e = 'png' THEN 'image/png' ELSE 'image/jpeg' END END AS mime, sha256(CASE WHEN kind = 'text' THEN text ELSE to_base64(encode(text)) END) AS content FROM k",
    }
