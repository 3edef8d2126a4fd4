"""The queries opN_<name> over the whole tables, with production parameters, and SQL for the two that SQL can express: removal
of repeated passages and near duplicates.  The others rest on a library's vocabulary or on a model trained here; tests hold
them against plain versions."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, lm_scoring, near_duplicates, personal_data, quality_rules, sentence_pieces, substring_dedup, token_counts, toxicity, url_filters
from .shared import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), limit=2048)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=50, full=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents")).drop("found")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=85)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": f"""
            WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
            s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
            x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM s),
            f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING count(*) > 1),
            g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE doc_id > first),
            p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
            k AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p.p) AS text FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p WHERE g.p IS NULL GROUP BY p.doc_id)
            SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
        "op8_near_duplicates": f"""
            WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
            s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
            n AS (SELECT doc_id, len(g) AS n, min(doc_id) OVER (PARTITION BY list_sort(g)) AS one FROM s),
            e AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s JOIN n USING (doc_id) WHERE doc_id = one),
            c AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
            l AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
            r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
            m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
            t AS (SELECT n.doc_id, n.n, CASE WHEN n.n = 0 THEN n.doc_id ELSE least(one, coalesce(m.b, one)) END AS component_id FROM n LEFT JOIN m ON n.one = m.a)
            SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM t""",
    }
