"""From raw documents to encoded training text, stage by stage; each stage reads what the one before it wrote.

Every stage but the last returns the columns of its input, whatever their names; an empty table gives an empty one.  Texts of
any length are read as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from embermill.llm import decontamination, near_duplicates, personal_data, quality_rules, sentence_pieces
from embermill.llm.shared import landed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the isolation forest keep.

    Null and empty texts fail the rules.  A score equal to the threshold is kept.  Repeated rows are judged alike, null ids like
    others; labels without a document, or null, are passed over.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Texts without a word, null ones among them, are nobody's duplicates and stay.  Of rows that repeat an id and text one stays.
    A null id gives way to any other; a group without ids keeps one text.
    """
    return near_duplicates.without_near_duplicates(docs, size=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, re-parameterised ones included.

    Null and empty texts, on either side, match nothing and stay.  Repeated rows go or stay together; null ids are values like
    others.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind; n_chars follows.

    Null and empty texts stay as they are, repeated rows come out alike.  Of overlapping spans the one that starts first counts.
    """
    return personal_data.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of all documents; null and empty texts have no pieces, repeated rows stay."""
    return sentence_pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("personal data", redact), ("sentence pieces", encode)]
#: The trained forest, the bootstrapped patterns and the encoder have no SQL form; tests/llm/test_brute.py holds the stages
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each one before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
