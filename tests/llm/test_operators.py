import collections
import hashlib
import math
import random
import re
import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from embermill.llm import decontamination, lm_scoring, near_duplicates, personal_data, quality_rules, sentence_pieces, substring_dedup, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(70))
ROWS = [
    (1, f"alpha beta {LONG} gamma", "en", "x"), (2, f"other start {LONG} other end", "en", None), (3, LONG, "en", "x"), (3, LONG, "en", "x"), (4, None, None, None), (5, "", "en", "x"),
    (6, "two words", "en", "x"), (7, "Two WORDS", "en", "x"), (None, LONG + " tail", "fr", "x"), (8, "<|endoftext|> É é it's\n\nline\nline\n  ", "fr", "x"), (9, "a" * 5000, "en", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (77, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def key(r):
    return (r[0] is None, r[0] or 0, repr(r))


def test_token_counts_equal_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    mine = sorted(token_counts.count_tokens(docs, path).collect(), key=key)
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=key)
    assert [tuple(r)[:3] for r in mine] == want


def test_pieces_equal_the_library_and_decode(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentence_pieces.encode_pieces(docs, path)
    assert sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=key) == sorted(((i, lib.encode(t or "")) for i, t, *_ in ROWS), key=key)
    assert out.where("not round_trip").count() == 0
    assert sorted(map(tuple, sentence_pieces.decode_pieces(out, path).collect()), key=key) == sorted(((i, t or "") for i, t, *_ in ROWS), key=key)


def test_pieces_of_odd_texts_equal_the_library(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for name, few in {"REMEMBERED": 40, "SLOTS": 7, "PAIRS": 5, "TOGETHER": 3, "LONG": 9}.items():
        monkeypatch.setattr(sentence_pieces, name, few, raising=False)
    own, r = sentence_pieces.Pieces(path), random.Random(1)
    kinds = ["abcdehilnorst", "the ing tion er and on re", "ab \n\t\r\u2581", "0123456789.,:-", "\u00e9\u00c9\u00df\u0301\u0394\u0416", "\u4e2d\u6587\u5b57\u65e5\u672c", "\U0001f600\U0001f468\u200d\ufffd\x00\x7f"]
    for _ in range(60):
        batch = ["".join(r.choice(r.choice(kinds[: r.randrange(1, 8)])) for _ in range(r.choice([0, 1, 5, 40, 300]))).replace("d", r.choice(["d", " "])) for _ in range(20)]
        got = [np.frombuffer(x, np.int32).tolist() for x in own.encode(batch)]
        assert got == lib.encode(batch)
        flat, offsets = np.array([i for x in got for i in x], np.int32), np.cumsum([0, *map(len, got)])
        assert list(own.decode_all(flat, offsets)) == [own.decode(x) for x in got] == [t.replace("\u2581", " ") for t in batch]


def test_pieces_take_no_python_call_each(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "texts", lambda docs: docs)
    path, r, calls, kinds = public_tokenizers.path("piece_bpe_32k.model"), random.Random(2), 0, ["th", "er", "on", "an", "re", "xq", "zu", "kle", "vy", "mo"]
    text = [" ".join("".join(r.choices(kinds, k=6)) for _ in range(500)) for _ in range(40)]
    sentence_pieces.pieces(path).encode(text[:1])
    work = sentence_pieces.encode_pieces(types.SimpleNamespace(mapInArrow=lambda f, schema: f), path)
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(text)], ["doc_id", "text"])

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = list(work(iter([batch])))
    finally:
        sys.setprofile(None)
    pieces = sum(sum(b.column("n_pieces").to_pylist()) for b in out)
    assert pieces > 60_000 and all(all(b.column("round_trip").to_pylist()) for b in out)
    assert calls < pieces / 2


def test_frequent_segments_are_searched_once(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 50)
    own, searched = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), collections.Counter()
    search, search_one = own.search, own.search_one
    monkeypatch.setattr(own, "search", lambda some: searched.update(some) or search(some))
    monkeypatch.setattr(own, "search_one", lambda one: searched.update([one]) or search_one(one))
    for k in range(5):
        own.encode(["often seen " + " ".join(f"w{k}x{i}" for i in range(60))])
        assert len(own.segments) <= 50 + 62
    assert searched["\u2581often"] == searched["\u2581seen"] == 1
    assert len(searched) == 302


def test_repeats_equal_brute_force(docs):
    big = 1 << 62
    first: dict = {}
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            at = tuple(w[k : k + 50])
            first[at] = min(first.get(at, big), big if i is None else i)
    want = []
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (big if i is None else i) for j in range(k, k + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in substring_dedup.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)


def test_near_duplicates(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == _components()


def _components():
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in ROWS:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[k : k + 3]) for k in range(len(w) - 2)])))
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    name = {r: min((sets[k][0] for k in range(len(sets)) if root[k] == r and sets[k][0] is not None), default=None) for r in root}
    return {(i, len(x), name[root[k]], i == name[root[k]]) for k, (i, x) in enumerate(sets)}


def test_decontamination_finds_reparameterised_items(spark):
    item = "Mary bought 12 red apples at the market near the old river bridge and later sold 12 of them to John for 30 dollars each"
    changed = item.replace("Mary", "Susan").replace("12", "45").replace("John", "Peter").replace("30", "7")
    clash = item.replace("bought 12", "bought 45").replace("sold 12", "sold 99")
    d = spark.createDataFrame([(1, f"before it {changed} after it", "x"), (2, f"so {clash}", "x"), (3, "nothing of the kind here at all", None), (4, None, None), (None, item, "x")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(9, item), (10, None), (11, "short one"), (11, "")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in decontamination.contaminated(d, b).collect()}
    assert got == {1: (True, [9]), 2: (False, []), 3: (False, []), 4: (False, []), None: (True, [9])}
    assert sorted(r.doc_id for r in decontamination.without_contaminated(d, b).collect()) == [2, 3, 4]
    assert decontamination.contaminated(d, b.limit(0)).where("contaminated").count() == 0


def test_decontamination_ignores_letter_case(spark):
    item = "The old keeper of the lighthouse wrote 3 letters to Anna and hid them in the straße under a weiß painted stone"
    changed = [item.upper(), item.lower(), item.title(), f"so it is that {item[0].lower()}{item[1:60]}", item.replace("lighthouse", "windmill").replace("them", "both").upper()]
    d = spark.createDataFrame(list(enumerate(changed)), "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (10, "İstanbul ΟΔΟΣ")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, list(r.item_ids)) for r in decontamination.contaminated(d, b).collect()}
    assert got == {0: (True, [9]), 1: (True, [9]), 2: (True, [9]), 3: (False, []), 4: (False, [])}
    assert [r.doc_id for r in decontamination.without_contaminated(d, b).orderBy("doc_id").collect()] == [3, 4]
    # the same windows by hand: equal words of all 13-word windows that the template does not join
    assert decontamination.contaminated(d, b).where("doc_id = 0").first().n_windows == len(item.split()) - 12


def test_decontamination_finds_verbatim_windows_of_few_literals(spark):
    short, dense = "Paris has 12 towers", "Anna 12 Bert 13 Carl 14 kg Dora 15 km Emil 16 saw Fritz 17"
    d = spark.createDataFrame([(1, f"we hear that {short} in all"), (2, f"so {dense} there"), (3, short.replace("12", "13")), (4, dense.replace("Dora", "Doris")), (5, dense.upper())], "doc_id long, text string")
    b = spark.createDataFrame([(7, short), (8, dense)], "item_id long, text string")
    got = {r.doc_id: (list(r.item_ids), r.n_windows) for r in decontamination.contaminated(d, b).collect()}
    assert got == {1: ([7], 1), 2: ([8], 3), 3: ([], 0), 4: ([], 0), 5: ([8], 3)}


def test_personal_data_discovers_by_context(spark):
    seeds = [(i, f"text {i} call tel: +49 30 {1000000 + 7919 * i} or mail a{i}@b.example.com", "x") for i in range(20)]
    d = spark.createDataFrame([*seeds, (50, "please tel: 555-123-4567 now", "x"), (51, "code 555-123-4567 is no number", "x"), (52, None, None), (53, "", "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in personal_data.personal_data(d).collect()}
    assert got[50].spans == "phone:12:24" and got[50].n_phone == 0 and got[51].spans == "" == got[52].spans
    assert got[0].n_email == got[0].n_phone == 1
    assert got[53].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r.text for r in personal_data.redacted(d).collect()}
    assert red[50] == "please tel: <phone> now" and red[52] is None and red[51] == "code 555-123-4567 is no number"


def test_personal_data_discovers_addresses_without_digits(spark):
    unseen = ["jane.doe(at)example.com", "jane[AT]host", "jane@localhost", "a@bc", f"{'long.' * 20}name(at)example.com"]
    seeds = [(i, f"text {i} mail: {'abcdefghijklmnopqrst'[i]}@b.example.com") for i in range(20)]
    d = spark.createDataFrame([*seeds, *((50 + i, f"so mail: {u}, soon") for i, u in enumerate(unseen)), (60, "meet jane(at)home there")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(d).collect()}
    assert [got[50 + i] for i in range(len(unseen))] == [f"email:9:{9 + len(u)}" for u in unseen] and got[60] == ""
    assert {r.text for r in personal_data.redacted(d).where("doc_id between 50 and 59").collect()} == {"so mail: <email>, soon"}
    personal_data.contexts("a" * 300_000 + "@" * 300_000 + " (at)" * 1000, [])


def test_base_spans_are_linear_and_exact():
    t = "x@y.com 1.2.3.4 1.2.3.999 4111 1111 1111 1111 4111111111111112 +1 (555) 123-4567"
    assert [t[s:e] for _, s, e in personal_data.base_spans(t)] == ["x@y.com", "1.2.3.4", "+1 (555) 123-4567"]
    personal_data.base_spans("1" * 300_000 + "@" * 1000 + "a" * 300_000)


def test_quality_rules_without_labels_and_edges(docs, labels):
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert got[4].base_failed and got[5].n_words == 0 and got[9].word_chars == 5000
    assert got[8].n_dup_lines == 1 and not got[1].base_failed
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://Example.COM/en/1?q", "http://www.example.com/en/", "http://x.net/fr/1", "nonsense", None, "http://a.com", "http://casino-bonus.example.org/win"]
    p = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(p).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[4][:3] == ("", "", None) == got[5][:3] and got[6][2] is None and got[7][3] == "block"


def test_lm_scores_base_and_order(docs):
    rows = sorted(lm_scoring.score(docs).collect(), key=key)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [(i, [*WORD.findall((t or "").translate(low)), None]) for i, t, *_ in ROWS]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    c = collections.Counter(w for i, ws in own if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in own), key=lambda r: (r[0] is None, r[0] or 0))
    for r, (i, k, known, base) in zip(rows, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, k, known, n) and r.base_score == pytest.approx(base) and r.score < 0


def test_toxicity_learns_outside_the_held_out_fold(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghiklmnorstu") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "horribleinsult"
        rows.append((i, " ".join(w), i % 4 == 0))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    held = [(got[i].predicted, int(y)) for i, _, y in rows if got[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held) and 0 <= got[9000].score <= 1
    assert toxicity.toxicity(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_empty_tables(spark, empty, labels):
    b = spark.createDataFrame([], "item_id long, text string")
    for out in (
        token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")), sentence_pieces.encode_pieces(empty, public_tokenizers.path("piece_bpe_32k.model")), substring_dedup.remove_repeats(empty), near_duplicates.near_duplicates(empty),
        decontamination.contaminated(empty, b), personal_data.personal_data(empty), quality_rules.judge(empty, labels), lm_scoring.score(empty), toxicity.toxicity(empty, labels), url_filters.judge(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert out.count() == 0


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count() and out.where("not round_trip").count() == 0
