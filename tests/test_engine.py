import duckdb
import pytest
from pyspark.sql import functions as F

from embermill import queries as q
from embermill.functions import keys
from embermill.operators import memo, retrieval
from embermill.plans import engine
from embermill.sources.providers import HashProvider, strict
from embermill.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(q.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize(("text", "out"), [("  hello   world ", "hello world"), ("a b", "a b"), ("a　b", "a b"), ("a\u0085b", "a b"), ("a\u001cb", "a\u001cb"), ("a​b", "a​b"), ("", ""), ("Hello\n\tWorld", "Hello World")])
def test_normalize(spark, text, out):
    assert spark.range(1).select(keys.normalize_text(F.lit(text))).first()[0] == out


def test_second_run_hits_and_duplicates_are_fetched_once(spark, tmp_path):
    items = spark.createDataFrame([(i, "m", t, t) for i, t in enumerate(["x", "x", "x", "y"])], "item long, model string, text string, key string")
    store = Store(spark, str(tmp_path / "log"))
    first = engine.run(items, store, HashProvider(), seq=1)
    assert first.where("is_hit").count() == 0 and first.where("vector is null").count() == 0
    assert store.log().count() == 2
    assert engine.run(items, store, HashProvider(), seq=2).where("not is_hit").count() == 0
    assert store.delete(items.select("key"), seq=3) == 4 and store.lookup().count() == 0 and store.ready()


def test_ttl_is_inclusive(spark, tmp_path):
    store = Store(spark, str(tmp_path / "log"))
    store.put(spark.createDataFrame([("k", [1.0])], "key string, vector array<float>"), seq=1, ttl=10, now=100)
    assert store.lookup(110).count() == 1 and store.lookup(111).count() == 0
    assert store.compact(str(tmp_path / "small"), 111).lookup().count() == 0


def test_strict_replies():
    assert strict({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], "usage": {"total_tokens": 7}}, 2) == ([[1], [2]], 7)
    for bad in ([{"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}] * 2, [{"index": 2, "embedding": [1]}, {"index": 0, "embedding": [1]}]):
        with pytest.raises(ValueError):
            strict({"data": bad}, 2)


def test_near_pair_and_zero_vector(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.a, r.b) for r in retrieval.near_pairs(v).collect()] == [(1, 2)]


def test_five_requests_one_claim(spark):
    r = spark.createDataFrame([("k", 1, i) for i in range(5)], "key string, ts long, request_id long")
    assert [x.request_id for x in memo.claims(r).where("claimed").collect()] == [0]
