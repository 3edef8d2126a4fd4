import http.server
import json
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from embermill import queries_flow as q
from embermill.client import Client
from embermill.config import Config
from embermill.operators import memo, metrics, retrieval
from embermill.plans import compositions, engine, requests
from embermill.sources import codecs, frames, wires
from embermill.sources.providers import HashProvider, Http, Stub, WireProvider, usage
from embermill.sources.store import BytesStore, FolderClient, Store
from embermill.streaming import stream
from embermill.trace import Spans, observed

SF = "/root/testdata/sf0.001"
KEY = "ab" * 32


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(q.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall()), key=repr)
    assert mine == want and mine


TO = wires.Target("http://e", "m", "query")


def test_calls_of_each_wire():
    both = ["a b", "c"]
    built = {name: w.build("k", TO, both[:1] if name == "titan" else both) for name, w in wires.wires().items()}
    body = {n: json.loads(c.body) for n, c in built.items()}
    assert built["openai"].url == "http://e/v1/embeddings" and body["openai"] == {"model": "m", "input": both} == body["mistral"]
    assert built["gemini"].url == "http://e/v1beta/models/m:batchEmbedContents" and built["gemini"].headers["x-goog-api-key"] == "k"
    assert body["gemini"]["requests"][0] == {"model": "models/m", "content": {"parts": [{"text": "a b"}]}}
    assert built["huggingface"].url == "http://e/models/m/pipeline/feature-extraction" and body["huggingface"] == {"inputs": both}
    assert built["titan"].url == "http://e/model/m/invoke" and body["titan"] == {"inputText": "a b"} and built["titan"].headers["Accept"] == "application/json"
    assert body["cohere"] == {"texts": both, "input_type": "query"}
    assert built["vertex"].url == "http://e/m:predict" and body["vertex"]["instances"][1] == {"content": "c", "task_type": "query"}
    assert body["foundry"] == {"model": "m", "input": both, "input_type": "query"} and built["foundry"].url == "http://e"
    assert wires.Azure("api-key").build("k", TO._replace(qualifier=None), both).headers["api-key"] == "k"
    image = json.loads(wires.Gemini().build("k", TO, [("image/png", "eA==")]).body)
    assert image["requests"][0]["content"]["parts"] == [{"inline_data": {"mime_type": "image/png", "data": "eA=="}}]
    with pytest.raises(ValueError):
        wires.Cohere().build("k", TO._replace(qualifier=None), both)
    with pytest.raises(ValueError):
        wires.Titan().build("k", TO, both)


def test_replies_of_each_wire():
    out = lambda x: json.dumps(x).encode()
    assert wires.Titan().read(out({"embedding": [1.0], "inputTextTokenCount": 4}), 1) == ([[1.0]], 4, 4)
    assert wires.Cohere().read(out({"embeddings": [[1], [2]]}), 2).vectors == wires.Cohere().read(out({"embeddings": {"float": [[1], [2]]}}), 2).vectors == [[1], [2]]
    predictions = [{"embeddings": {"values": [1], "statistics": {"token_count": 3}}}, {"embeddings": {"values": [2]}}]
    assert wires.Vertex().read(out({"predictions": predictions}), 2) == ([[1], [2]], 3, 3)
    assert wires.Gemini().read(out({"embeddings": [{"values": [1]}]}), 1) == ([[1]], 0, 0)
    assert wires.Azure().read(out({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}), 2).vectors == [[1], [2]]
    for w, reply in ((wires.HuggingFace(), [[1]]), (wires.Gemini(), {"embeddings": []}), (wires.Vertex(), {"predictions": predictions[:1]}), (wires.Cohere(), {"embeddings": [[1]]}), (wires.OpenAi(), {"data": [{"index": 0, "embedding": [1]}] * 2})):
        with pytest.raises(ValueError):
            w.read(out(reply), 2)


@pytest.fixture
def server():
    seen, plan = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, dict(self.headers), json.loads(body)))
            code = plan.pop(0) if plan else 200
            out = Stub().send(wires.Call("", {}, body)) if code == 200 else b"{}"
            self.send_response(code)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen, plan
    s.shutdown()


def test_http_calls_are_tried_again_only_where_it_helps(server):
    url, seen, plan = server
    provider = WireProvider(Http(pause=0.01))
    plan += [429, 503, 500]
    assert provider.embed("k", "openai", wires.Target(url, "m"), ["a b"]).total_tokens == 2 and len(seen) == 4
    assert seen[0][0] == "/v1/embeddings" and seen[0][1]["Authorization"] == "Bearer k"
    plan += [429] * 4
    with pytest.raises(Exception, match="429"):
        provider.embed("k", "openai", wires.Target(url, "m"), ["a"])
    assert len(seen) == 8
    plan.append(403)
    with pytest.raises(Exception, match="403"):
        provider.embed("k", "openai", wires.Target(url, "m"), ["a"])
    assert len(seen) == 9


@pytest.mark.parametrize(("strategy", "n", "sizes"), [("openai", 150, [50, 100]), ("cohere", 100, [4, 96]), ("vertex", 260, [10, 250]), ("titan", 3, [1, 1, 1])])
def test_call_sizes(spark, strategy, n, sizes):
    size = wires.wires()[strategy].max_batch
    items = spark.range(n).select(F.col("id").alias("item"), F.lit(strategy).alias("provider"), F.lit(strategy).alias("strategy"), F.lit("m").alias("model"), F.lit("q").alias("qualifier"), F.lit(size).alias("max_batch"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    none = items.select("key", F.array().cast("array<float>").alias("vector")).limit(0)
    _, fetched = engine.embed_items(items, none, WireProvider(Stub()))
    fetched = fetched.cache()
    assert sorted(r["count"] for r in fetched.groupBy("call").count().collect()) == sizes
    told = usage(fetched).first()
    assert told["calls"] == len(sizes) and told["total_tokens"] == (0 if strategy == "cohere" else 2 * n)


def test_numbering_over_stretches(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 5000).alias("o"), (F.col("id") % 3).alias("g"))
    got = memo.numbered(rows, ["g"], "o", stretch=100).collect()
    for g in range(3):
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(sum(r["g"] == g for r in got)))


def test_a_batch_run_again_neither_calls_nor_changes(spark, tmp_path):
    items = spark.createDataFrame([(i, "m", t, t) for i, t in enumerate(["x", "x", "y"])], "item long, model string, text string, key string")
    store = Store(spark, str(tmp_path / "log"))
    first, one = engine.billed(items, store, HashProvider(), seq=1, at=str(tmp_path / "run"))
    again, two = engine.billed(items, store, _Broken(), seq=1, at=str(tmp_path / "run"))
    assert sorted(first.collect()) == sorted(again.collect()) and one.count() == two.count() == 2
    assert again.where("is_hit").count() == 0 and store.lookup().count() == 2
    assert engine.run(items, store, _Broken(), seq=2).where("is_hit").count() == 3


def _Broken():
    class Broken:  # made here, so that workers get it by value
        version = "1"

        def embed(self, key, strategy, to, inputs):
            raise RuntimeError("called")

    return Broken()


def test_failed_provider_leaves_nothing(spark, tmp_path):
    items = spark.createDataFrame([(0, "m", "x", "x")], "item long, model string, text string, key string")
    store = Store(spark, str(tmp_path / "log"))
    with pytest.raises(Exception, match="called"):
        engine.run(items, store, _Broken(), seq=1)
    assert store.lookup().count() == 0


def test_stream_repeated_batch(spark, tmp_path):
    items = spark.createDataFrame([(i, "m", t, t) for i, t in enumerate(["x", "x", "y"])], "item long, model string, text string, key string")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    items.write.parquet(source)
    store = Store(spark, str(tmp_path / "log"))
    stream.embed_stream(spark.readStream.schema(items.schema).parquet(source), store, HashProvider(), out, check).awaitTermination()
    before = sorted(map(str, spark.read.parquet(out).collect()))
    # the batch's commit is lost: it runs again, with a provider that must not be called
    commits = tmp_path / "check" / "commits"
    for f in commits.iterdir():
        f.unlink()
    stream.embed_stream(spark.readStream.schema(items.schema).parquet(source), store, _Broken(), out, check).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).collect())) == before and len(before) == 3


def test_bytes_store(spark, tmp_path):
    path = str(tmp_path / "kv")
    store = BytesStore(lambda: FolderClient(path))
    rows = spark.createDataFrame([(KEY, [1.0, 2.5]), ("cd" * 32, [3.0])], "key string, vector array<float>")
    store.put(rows, 1, ttl=10, now=100)
    keys = spark.createDataFrame([(KEY,), ("ef" * 32,), (KEY,)], "key string")
    assert [(r.key, r.vector, r.expires_at) for r in store.lookup(110, keys).collect()] == [(KEY, [1.0, 2.5], 110)]
    assert store.lookup(111, keys).count() == 0
    assert store.delete(keys, 2) == 3 and store.lookup(None, keys).count() == 0
    items = spark.createDataFrame([(0, "m", "x", KEY)], "item long, model string, text string, key string")
    assert not engine.run(items, store, HashProvider(), 3).first()["is_hit"] and engine.run(items, store, _Broken(), 4).first()["is_hit"]


def test_codecs():
    assert codecs.unpack(codecs.pack([1.5, -2]) + b"xyz").tolist() == [1.5, -2.0]
    assert codecs.pack_expiring([1], 258)[:8] == bytes([2, 1, 0, 0, 0, 0, 0, 0])
    assert codecs.unpack_expiring(codecs.pack_expiring([], None))[0] is None
    with pytest.raises(ValueError):
        codecs.unpack_expiring(b"123")


def test_config(spark):
    c = Config.read({"EMBERMILL_TTL": "30", "EMBERMILL_STORE": "what", "EMBERMILL_AZURE_AUTH_MODE": "api-key", "EMBERMILL_OPENAI_BASE_URL": ""})
    assert c.ttl == 30 and c.store == "parquet" and c.azure_auth_mode == "api-key" and c.openai_base_url == "https://api.openai.com"
    assert [Config.read({"EMBERMILL_TTL": t}).ttl for t in ("0", "", "abc", "-5", "30\n", None)] == [None] * 6
    assert {r["name"] for r in c.registry(spark).collect()} == {"openai", "mistral", "gemini", "huggingface", "bedrock", "vertexai"}
    assert Config(azure_openai_base_url="x").registry(spark).where("name = 'azure'").count() == 1


def test_client(spark, server, tmp_path):
    url, seen, _ = server
    client = Client(spark, Store(spark, str(tmp_path / "log")), Config(openai_base_url=url, gemini_base_url=url), budget=60)
    a = client.embed("openai", "sk", "m", ["b  c", "d", "b c"])
    assert (a.status, a.hits, a.misses, a.total_tokens, len(a.vectors)) == (200, 0, 3, 3, 3) and a.vectors[0] == a.vectors[2]
    assert len(seen) == 1 and seen[0][2]["input"] == ["b c", "d"]
    assert client.embed("openai", "sk", "m", "d").hits == 1 and client.embed("openai", "other", "m", "d").hits == 0
    assert client.delete("openai", "sk", "m", ["d", "never"]).deleted == 2 and client.embed("openai", "sk", "m", "d").misses == 1
    assert client.embed("nobody", "sk", "m", "d").status == 404 and client.embed("openai", "sk", "m", []).vectors == []
    image = "data:image/png;base64,eA=="
    assert client.embed("gemini", "sk", "g", [image, image], images=True).misses == 2 and client.embed("gemini", "sk", "g", image, images=True).hits == 1
    assert client.embed("openai", "sk", "g", image, images=True).status == 404 and client.embed("gemini", "sk", "g", "no uri", images=True).status == 400
    assert {s["name"] for s in client.spans.done} == {"embed", "store_delete"}


def test_budget(spark):
    import time

    assert engine.within(spark, 60, lambda: 7) == 7
    with pytest.raises(engine.StoreTimeout):
        engine.within(spark, 0.2, lambda: time.sleep(3))
    with pytest.raises(KeyError):
        engine.within(spark, 60, lambda: {}["x"])


def test_spans_and_counts(spark):
    spans = Spans()
    with pytest.raises(KeyError), spans.span("outer"), spans.span("inner", provider="p"):
        raise KeyError
    assert [(r["name"], r["parent"], r["failed"]) for r in spans.done] == [("inner", "outer", True), ("outer", None, True)] and json.loads(spans.lines()[0])["provider"] == "p"
    df, seen = observed(spark.createDataFrame([(True,), (False,), (False,)], "is_hit boolean"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"items": 3, "hits": 1, "misses": 2}


def test_folder_ingest(spark, tmp_path):
    for name, content in (("a.md", "text é"), ("b.txt", "two"), ("c.png", "x"), ("d.jpeg", "y"), ("e.pdf", "no")):
        (tmp_path / name).write_text(content, "utf-8")
    got = {r["id"]: (r["text"], r["mime"], r["data"]) for r in compositions.files(spark, str(tmp_path)).collect()}
    assert got == {"text:a.md": ("text é", None, None), "text:b.txt": ("two", None, None), "image:c.png": (None, "image/png", "eA=="), "image:d.jpeg": (None, "image/jpeg", "eQ==")}


def test_index_by_kind(spark, tmp_path):
    rows = spark.createDataFrame([("text:a", "text", [1.0]), ("image:b", "image", [2.0])], "id string, kind string, vector array<float>")
    retrieval.write_index(rows, str(tmp_path / "index"))
    found = retrieval.of_kind(spark.read.parquet(str(tmp_path / "index")), "image")
    assert [r["id"] for r in found.collect()] == ["image:b"] and "PartitionFilters: [isnotnull(kind" in found._jdf.queryExecution().toString()


def test_blocks_of_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 4))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sim = u @ u.T
    monkeypatch.setattr(retrieval.unit, "__defaults__", ("vec_id", "embedding", 40))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= 0.9}
    assert {(r["a"], r["b"]) for r in retrieval.near_pairs(df, 0.9).collect()} == want
    asked = df.where("vec_id % 50 = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(asked, df, 5).collect()}
    for q_ in range(3, 300, 50):
        order = sorted((j for j in range(300) if j != q_), key=lambda j: (-sim[q_, j], j))[:5]
        assert [got[q_, k + 1] for k in range(5)] == order


def test_metric_lines(spark):
    lines = spark.createDataFrame([('a_total{content_type="text",provider="p"} 3',), ('a_total{provider="q",content_type="text"} 4.5',), ("# HELP a_total x",), ("a_total{} x",)], "value string")
    assert metrics.sum_metric(lines, "a_total").first()["total"] == 7.5 and metrics.sum_metric(lines, "a_total", provider="q").first()["total"] == 4.5
    assert metrics.sum_metric(lines, "b_total").first()["total"] == 0


def test_frames_as_files(spark, tmp_path):
    body = json.dumps({"model": "m", "input": ["a", "b"]})
    rows = [{"request_id": 1, "provider": "openai", "authorization": "Bearer k", "body": body}, {"request_id": 2, "provider": "openai", "body": body}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, rows), "broken"]))
    config = Config()
    seen = requests.judged(frames.read_requests(spark, str(tmp_path / "in")), config)
    assert sorted((r.request_id or 0, r.status) for r in seen.collect()) == [(0, 400), (1, 200), (2, 401)]
    items = requests.items(seen, config)
    done, fetched = engine.billed(items, Store(spark, str(tmp_path / "log")), WireProvider(Stub()), 1, order="place", at=str(tmp_path / "run"))
    frames.write_answers(requests.answers(seen, done, fetched), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("status = 200 and hits = 0 and misses = 2").count() == 1
    stream_in = frames.stream_requests(spark, str(tmp_path / "in"))
    frames.stream_judgement(requests.judged(stream_in, config), str(tmp_path / "judged"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "judged")).where("status = 401").count() == 1
    frames.write_lines(spark, ["one", "two"], str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
