"""Personal data: base patterns for e-mail, IP, card and phone, then bootstrapped contextual extraction.

What the base patterns find are the seeds.  Patterns are lexical: the word before an entity, the two words before, the word
after, the words on both sides, and the token's own shape (runs of digits and of letters).  A pattern's confidence in a kind
is the share of known entities of that kind among the distinct instances it has, smoothed; strangers count against it by a
quarter if they could be of the kind and fully if not, and always fully against a shape, which all that fail the base
patterns have in common with what passes.  An instance is believed in as far as its patterns are:
1 - product(1 - confidence).  Spark scores patterns and instances in turn; those believed in join the known ones.  Trusted
patterns then discover identifiers that no base pattern covers.  Texts are read once; what is written and scored are spans
and their contexts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, landed, lean, salted, sliced, texts

#: The kinds in order, and the base patterns (written so that each text is scanned once).
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+(?:\x20[0-9().-]*[0-9][0-9().-]*(?![^\x20\x09-\x0D]))*")
_AT, _SPACES, _WHITE = re.compile(r"@|\(at\)|\[at\]", re.I), re.compile(r"[\x20\x09-\x0D]"), " \t\n\v\f\r"
_AROUND = " \t\n\r\v\f.,;:!?\"'`*#$%&|<>(){}[]=~_/\\-"
#: Rounds of scoring, confidence that a pattern or instance needs, what is added to a pattern's counter-evidence (so that it
#: needs nine known instances at least), and characters above which a word is told by its digest.
ROUNDS, TRUST, DOUBT, LONGEST = 3, 0.9, 0.9, 64
_SPAN = "array<struct<kind: string, start: int, end: int>>"
_CASE = "array<struct<patterns: array<string>, instance: string, kind: string, could: string, start: int, end: int>>"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from each @: the local part is the run before it, no further back than the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start."""
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _could_be(token: str) -> str:
    """The kinds, comma-joined, that a token not covered by a base pattern could be an unusual writing of."""
    token = token.lower()
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    fits = [("email", letters >= 3 and ("@" in token or "(at)" in token or "[at]" in token)), ("ip", not letters and token.count(".") == 3 and digits >= 4), ("card", not letters and 13 <= digits <= 19), ("phone", not letters and 7 <= digits <= 15)]
    return ",".join(k for k, ok in fits if ok)


def _word(text: str, at: int, step: int) -> tuple[str, int]:
    """The word that ends before `at` (step -1) or begins from it (step 1), and its far end; empty where the text ends."""
    reach = LONGEST
    while True:
        piece = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
        words = _SPACES.split(piece.strip(_WHITE))
        whole = at - reach <= 0 if step < 0 else at + reach >= len(text)
        if whole or len(words) > 1:
            word = words[-1 if step < 0 else 0]
            return word, (at - len(piece) + piece.rfind(word) if step < 0 else at + piece.find(word) + len(word))
        reach *= 2


def _plain(word: str, empty: str) -> str:
    word = re.sub("[0-9]+", "0", word.lower()).strip(_AROUND.replace(":", "").replace("=", "").replace("#", ""))
    return (hashlib.sha256(word.encode()).hexdigest() if len(word) > LONGEST else word) or empty


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns of an entity at these places, each with its sort in front."""
    near, at = _word(text, start, -1)
    far, after = _word(text, at, -1)[0], _word(text, end, 1)[0]
    near, far, after = _plain(near, "^"), _plain(far, "^"), _plain(after, "$")
    shape = re.sub("[a-z]+", "a", re.sub("[0-9]", "0", text[start:end].lower()))
    return [f"before {near}", f"two {far} {near}", f"after {after}", f"both {near} {after}", f"shape {_plain_shape(shape)}"]


def _plain_shape(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest() if len(shape) > LONGEST else shape


def _strangers(text: str) -> list[tuple[int, int]]:
    """Spans of words with digits, and of words without any that hold an @, (at) or [at], in order."""
    out, done = [m.span() for m in _NUMBERED.finditer(text)], 0
    for m in _AT.finditer(text):
        if m.start() >= done:
            start = max(done, *(text.rfind(c, done, m.start()) + 1 for c in " \t\n\v\f\r"))
            after = _SPACES.search(text, m.end())
            done = after.start() if after else len(text)
            if not any("0" <= c <= "9" for c in text[start:done]):
                out.append((start, done))
    return sorted(out)


def _told(instance: str) -> str:
    """Lower case; a long one by its digest, so that no long text travels."""
    instance = instance.lower()
    return hashlib.sha256(instance.encode()).hexdigest() if len(instance) > LONGEST else instance


def contexts(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Known entities and strangers outside them, each with its patterns.  Numbers of fewer than six characters,
    which could be of no kind, are not looked at."""
    out = [{"patterns": patterns(text, s, e), "instance": _told(text[s:e]), "kind": k, "could": k, "start": s, "end": e} for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    for start, end in _strangers(text):
        token = text[start:end]
        start, end = start + len(token) - len(token.lstrip(_AROUND)), end - len(token) + len(token.rstrip(_AROUND))
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        could = _could_be(text[start:end])
        if (end - start < 6 and not could) or (i < len(taken) and taken[i][0] < end):
            continue
        out.append({"patterns": patterns(text, start, end), "instance": _told(text[start:end]), "kind": None, "could": could, "start": start, "end": end})
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    case = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("kind", pa.string()), ("could", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in (part for whole in batches for part in sliced(whole)):
        spans, digests, cases = [], [], []
        for t in b.column("text").to_pylist():
            t = t or ""
            base = base_spans(t)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
            cases.append(contexts(t, base))
        yield pa.record_batch([b.column("doc_id"), pa.array(spans, span), pa.array(digests, pa.string()), pa.array(cases, case), b.column("print")], ["doc_id", "base", "base_sha256", "cases", "print"])


def trusted_patterns(cases: DataFrame) -> DataFrame:
    """(pattern, kind, trust) of the patterns trusted in the end; cases has pattern, instance, kind (null: a stranger) and could."""
    graph = cases.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"), F.max("could").alias("could"))
    graph = landed(graph, "contexts")
    seeds = graph.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    known = seeds
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("of")
    for turn in range(ROUNDS):
        seen = graph.join(known, "instance", "left").select("pattern", "instance", "kind", "could", "belief", kinds)
        weight = F.when(F.col("kind") == F.col("of"), F.col("belief")).otherwise(0.0)
        maybe = F.col("kind").isNull() & F.array_contains(F.split("could", ","), F.col("of")) & ~F.col("pattern").startswith("shape ")
        against = F.when(F.col("kind") == F.col("of"), 0.0).when(maybe, 0.25).otherwise(1.0)
        scored = seen.groupBy("pattern", "of").agg(F.sum(weight).alias("for"), F.sum(against).alias("against"))
        trust = F.col("for") / (F.col("for") + F.col("against") + DOUBT)
        trusted = landed(scored.select("pattern", F.col("of").alias("kind"), trust.alias("trust")).where(F.col("trust") >= TRUST), "patterns")
        if turn == ROUNDS - 1:
            return trusted
        best = trusted.groupBy("pattern").agg(F.max_by(F.struct("kind", "trust"), "trust").alias("b")).select("pattern", "b.kind", "b.trust")
        strangers = salted(graph.where("seed is null"), best, "pattern", "instance").where(F.array_contains(F.split("could", ","), F.col("kind")))
        believed = strangers.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("belief")).where(F.col("belief") >= TRUST)
        one = believed.groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("b")).select("instance", "b.kind", "b.belief")
        known = landed(seeds.unionByName(one), "known")
    raise AssertionError


def personal_data(docs: DataFrame, prints: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and discovered, kind:start:end in code
    points, joined by commas) and found (the same as an array) of every row.

    Null and empty texts have no spans.  Repeated rows come out alike, each with its own row; null ids are kept; other
    columns are ignored.  A discovered span never overlaps a base span; where patterns of several kinds fit, the most trusted
    decides, then the kind's name.  With `prints` a hash of the text is a column too.
    """
    schema = f"doc_id long, base {_SPAN}, base_sha256 string, cases {_CASE}"
    own = texts(docs).withColumn("print", F.xxhash64("text"))
    rows = landed(own.mapInArrow(lean(_found), f"{schema}, print long").withColumn("row", F.monotonically_increasing_id()), "spans")
    cases = rows.select("row", F.explode("cases").alias("c")).select("row", "c.*")
    every = cases.select("row", F.explode("patterns").alias("pattern"), "instance", "kind", "could", "start", "end")
    best = trusted_patterns(every).groupBy("pattern").agg(F.max(F.struct("trust", "kind")).alias("b")).select("pattern", F.col("b.kind").alias("of"), "b.trust")
    strangers = every.where("kind is null and could <> ''").drop("kind")
    fit = salted(strangers, best, "pattern", "row", "start").where(F.array_contains(F.split("could", ","), F.col("of")))
    added = fit.groupBy("row", "start", "end").agg(F.max(F.struct("trust", "of")).alias("b"))
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("b.of").alias("kind"), "start", "end")).alias("more"))
    both = rows.select("row", "doc_id", "base", "base_sha256", "print").join(landed(added, "added"), "row", "left")
    order = F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))))
    found = F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))), lambda s: F.struct(F.element_at(order, s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    counts = [_count(kind) for kind in KINDS]
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.withColumn("found", found).select("doc_id", *counts, "base_sha256", joined.alias("spans"), "found", *(["print"] if prints else []))


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"], s["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with each span replaced by its kind in angle brackets (overlapping spans by the first
    one's); n_chars, where there is one, follows.

    Texts without spans, null and empty ones among them, stay as they are; repeated rows stay and come out alike.  Columns of
    any name come through.
    """
    print_, found = fresh(docs, "print"), fresh(docs, "found")
    spans = personal_data(docs, prints=True).where(F.size("found") > 0).select(F.col("print").alias(print_), F.col("found").alias(found)).dropDuplicates([print_])
    own = docs.withColumn(print_, F.xxhash64(F.coalesce("text", F.lit(""))))
    both = salted(own, landed(spans, "found"), print_, "doc_id", how="left").drop(print_)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in sliced(whole)):
            cols = {name: b.column(name) for name in names}
            if b.column(found).null_count < b.num_rows:
                text, at = b.column("text").to_pylist(), b.column(found).to_pylist()
                new = [t if s is None else _replaced(t, s) for t, s in zip(text, at, strict=True)]
                cols["text"] = pa.array(new, b.schema.field("text").type)
                if "n_chars" in cols:
                    n = [old if s is None else len(t) for old, t, s in zip(cols["n_chars"].to_pylist(), new, at, strict=True)]
                    cols["n_chars"] = pa.array(n, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(cols)

    return both.mapInArrow(lean(run), docs.schema)
