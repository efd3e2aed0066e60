"""From raw documents to training sequences, stage by stage.

Each stage is one operator of quadrille.llm over all that the stage before kept: documents
that the toxicity machine rejects go; lines that many documents share go, but for one
holder; of near-duplicates (five-word shingles, similarity 0.8 or more; SimHash proposes pairs, and min-hash those too far apart for it) one document stays;
sources are mixed to their target weights, documents repeated or left out as wholes; what
is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import linededup, mixing, packing, shingles, simhash, toxicity
from quadrille.llm.common import shared_folder, table
from quadrille.llm.queries import vocabulary
from quadrille.storage import Folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingles.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models and the hashes of the stages have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again.

    A stage's files go once the next stage's are written; the last stage's stay, as the result reads them.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            Folder(spark, before).delete()
        before = f"{folder}/{name}"
    return docs
