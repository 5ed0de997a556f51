"""A training-data pipeline over ``documents``: five stages, each one of the library's text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelespan.llm import decontamination, ngram_join, pii, sentencepiece_codec, toxicity
from allelespan.llm.arrow_columns import free_name
from allelespan.llm.linking import written
from allelespan.llm.queries import PII_KEY, piece_model, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity classifier does not call toxic.

    It is fitted on ``labels`` and the documents they name; held-out labels take no part.
    """
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    into = free_name(docs, "score")
    return toxicity.score(docs, classifier, into=into).filter(F.col(into) < 0.5).drop(into)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the group's smallest id."""
    return ngram_join.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no window of a benchmark item occurs."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_spans") == 0).select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data; lengths don't change."""
    return pii.pseudonymize(docs, PII_KEY, any_area=True).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    coded = sentencepiece_codec.encode(docs, piece_model(), into="ids")
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's documents; every stage is written and reread, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
