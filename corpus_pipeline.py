"""The corpus pipeline: quality rules, quality classifier, near copies, mix, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next stage's documents.  All but the last keep the columns of documents.

Defined results, of every stage: null and empty texts count as texts without words, which the rules reject;
texts are taken whole, however long; repeated rows are judged each, and one of them passes the near-copy stage;
null ids are judged like others and are never learned from; ties are settled by id and text; an empty table gives
an empty table; columns of the input may have any names and come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import byte_bpe, curriculum, near_copies, preference, quality_rules
from ledgerloom.llm.common import settle, table
from ledgerloom.llm.queries import BPE_FILE, tokenizer_file


def drop_rule_failures(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the isolation forest accept (operator 8)."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that rank above the cut (operator 1)."""
    return preference.keep_preferred(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 6): five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_similar_once(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, whole texts only, in training order (operator 5)."""
    return curriculum.training_order(docs, whole_texts=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, the ids, their number, and whether decoding gave the text back (operator 3)."""
    return byte_bpe.encode_checked(docs.select("doc_id", "source", "text"), *tokenizer_file(BPE_FILE)).select("doc_id", "source", "n_tokens", "ids", "lossless")


STAGES = [
    ("quality_rules", drop_rule_failures),
    ("quality_classifier", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Forests, rankings, fingerprints and merges have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
