"""A training corpus from raw documents, in five stages. Each stage gets all that its predecessor kept.

All but the last return the columns of documents. A stage's result is written as Parquet in the shared folder and
read again as the next one's documents, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, pii, quality_model, sentencepieces
from tallyloom.llm.common import materialize, own, table
from tallyloom.llm.queries import ACCEPT, piece_model


#: Rows of long texts that a scan and an Arrow batch hold at once. Spark's own numbers are made for narrow rows: with them
#: an executor's heap took 1,830 MB on 0.1 GB of documents, with these 1,250 MB, in the same time.
SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1500"}


def settle(spark: SparkSession) -> None:
    """Gives the session SETTINGS, but for those that it sets itself. They stay for what runs after the pipeline."""
    chosen = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the raw documents' labelled sample.

    Null and empty texts are judged by the score of a text without words; rows of one text fare alike, repeated ones
    too; very long texts are scored whole; a score at the bound stays; no documents give none. All columns stay as they
    are, whatever they are called.
    """
    settle(spark)
    model, score = quality_model.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), own("score")
    return quality_model.score(docs, model, column=score).where(F.col(score) >= ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest id.

    Documents without words, null texts too, all stay; a null id counts as the largest; rows that share an id are
    judged one by one, and of rows that share id and text one stays; a similarity of exactly 0.8 links; very long texts
    are compared whole; no documents give none. All columns stay as they are, whatever they are called.
    """
    settle(spark)
    return jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts have none; each row is judged by itself, repeated ones alike; very long texts are scanned
    whole; an empty benchmark takes nothing; no documents give none. All columns stay as they are, whatever they are
    called.
    """
    settle(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    A null text stays null and keeps its n_chars; of spans that overlap the first that starts is replaced; repeated
    rows stay and fare alike; very long texts are scanned whole; no documents give none. All other columns stay as they
    are, whatever they are called.
    """
    settle(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens and whether decoding the ids gives the text back.

    A null text has the ids of the empty text, none, and gives that back; repeated rows stay and fare alike; very long
    texts are encoded whole; no documents give none. Other columns stay as they are; those named like one of the three,
    in any letter case, give way.
    """
    settle(spark)
    return sentencepieces.reencode(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
