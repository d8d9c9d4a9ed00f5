"""A corpus pipeline: each stage applies one operator to what the one before it kept.

Cases, in every stage: null texts count as empty; null ids, languages and
sources are values of their own; very long texts are taken whole; an empty
table gives an empty one; columns beside those of documents are kept, whatever
their names, up to the last stage, which does not read them. Each stage says
what it does with repeated rows and texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import mixing, packing, secrets, simhash, toxicity
from tidewheel.llm.common import remove, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on those labelled ones that are not held out.

    Equal texts of one language go or stay together, empty ones too. Labels of
    one class, or none, reject by the share of toxic labels alone.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document of the smallest id stays.

    Texts without words are one component. Null ids are larger than any other;
    of rows that are alike in id and text one stays.
    """
    return simhash.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; secrets in their texts are replaced and null texts stay null."""
    return secrets.redact_all(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: not at all, once or twice.

    Texts without words are not taken; rows alike in id and text share their copies.
    """
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into windows; each row is packed once, texts without tokens as their end id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secret_redaction", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: No SQL expresses a trained classifier; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage has read goes when it is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
