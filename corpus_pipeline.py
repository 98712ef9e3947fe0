"""The corpus pipeline: documents through five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with
the columns of documents, in their order, whatever other columns ``docs`` has;
the last returns tokens.  Every stage takes an empty table and gives an empty
one.  Ids may repeat and be null.  Copies that the mix takes in several epochs
stay several rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.scratch import remove, shared_dir
from fathom.llm.bpe import encode
from fathom.llm.exact_dedup import dedup_exact
from fathom.llm.mixing import mix_sources
from fathom.llm.quality import Model, batch_stats, filter_quality, fit_quality
from fathom.llm.simhash import drop_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _model(spark: SparkSession, sf_dir: str) -> Model | None:
    """The quality classifier, fitted on the labelled documents of ``sf_dir``."""
    return fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null text counts as empty, and both go if the classifier finds the empty
    text bad; equal texts stay or go together; without labels all stay.
    """
    return filter_quality(docs, _model(spark, sf_dir)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the least id.

    Null ids rank last; of rows equal in id and text one stays; rows of a null
    text all stay; the empty text is a text.
    """
    return dedup_exact(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Null ids rank last; of an id with several texts each is a document of its
    own; texts without a word, null ones too, all stay.
    """
    return drop_near(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at shares of tokens ** 0.7, whole epochs first, then by keys scaled by the classifier's probability.

    A document in several epochs is several rows.  A null source is a source; a
    source without a word goes; other rows without a word come with each whole
    epoch.  Without labels all weights are 1.
    """
    model = _model(spark, sf_dir)

    def weights(texts: pa.Array) -> np.ndarray:
        if model is None:
            return np.ones(len(texts))
        # rounded, so that it doesn't depend on the batch that a text comes in
        return np.maximum(np.round(model.probability(model.raw(batch_stats(texts))), 4), 0.01)

    return mix_sources(docs, scorer=weights).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's id, source, tokens and their number; null tokens and number for a null text."""
    coded = encode(docs.select("doc_id", "source", "text"))
    return coded.withColumn("n_tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote is deleted when the next one has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


#: SQL can express neither the classifier nor near copies nor BPE.
ORACLE_SQL = None
