"""The corpus pipeline: drop toxic documents, then exact and near copies; mix sources; encode.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs, sf_dir), ``docs`` being what the stage before it returned,
and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next one, so that a lost executor costs at most a stage; what a stage has read and made is deleted after it.

Each row is judged by its text in the toxicity stage. In the dedup stages rows whose doc_id repeats are one document: a stage that keeps a doc_id keeps all rows
that have it. Rows with a null doc_id are never joined to a decision and are kept by these stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from cellweft.llm.common import without
from cellweft.llm.queries import RANKS
from cellweft.runtime import discard, materialize, relieve, sweep, table, tables_made

#: Iterated and fitted stages cannot be said in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, fitted on this stage's input and the labels outside the held-out fold, does not predict to be toxic."""
    relieve(spark)
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest doc_id."""
    found = exact_dedup.exact_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("of"))
    return without(docs, materialize(found.dropna().distinct(), "pipeline-copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 percent of their five-word shingles, the document with the smallest doc_id."""
    found = jaccard_join.jaccard_components(docs, width=5, percent=80).where("component_id != doc_id").select(F.col("doc_id").alias("of"))
    return without(docs, materialize(found.distinct(), "pipeline-near"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken, cut at the word where its source's budget ends."""
    relieve(spark)
    taken = mixing.mix_sources(docs)
    relieve(spark)
    return taken.documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every mixed text."""
    relieve(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, read = tables_made(), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
            sweep(spark, before, docs)
            discard(read)
    return docs
