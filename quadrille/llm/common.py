"""What several operators of this folder share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled, shared_folder

#: The characters that the contracts call white space: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() has a fast path for plain ASCII and is right there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, but for single rows, so many bytes of a text column."""
    for batch in batches:
        total, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            end = max(at + 1, min(at + rows, end))
            yield batch.slice(at, end - at)
            at = end


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def py_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled documents outside the held-out quarter.

    The rows of lowest hash are taken, so reruns agree. The ids are bounded by `limit`,
    which is why they may be broadcast against the documents. A null label is none; of
    several labels of one id the largest counts, of several texts that of the lowest hash.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    found = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    return found.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b) of longs; label is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written to the
    checkpoint folder; the number of rounds grows with the logarithm of the longest path.
    Joins use a derived key, so both sides are exchanged and Spark can split a hub's rows.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        large = _with_least(_both(edges, ("a", "b"), ("b", "a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = settled(_both(_with_least(large), ("a", "m"), ("b", "m")).where("a <> b").distinct())
    return _both(edges, ("a", "b"), ("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("label"))


def _both(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) of several pairs of columns. A union would compute df for each."""
    return df.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))).alias("_e")).select("_e.a", "_e.b")


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with m, the least of a and its neighbours."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    left = edges.withColumn("_k", F.xxhash64("a"))
    right = least.select(F.xxhash64("a").alias("_k"), F.col("a").alias("_a"), "m")
    return left.join(right, (left["_k"] == right["_k"]) & (F.col("a") == F.col("_a"))).select("a", "b", "m")


def with_group_min(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """df with the least value of each row's group. The join is over a derived key, so both sides are exchanged and Spark can split a large group."""
    least = df.groupBy(group).agg(F.min(value).alias(out)).select(F.xxhash64(group).alias("_gk"), F.col(group).alias("_g"), out)
    left = df.withColumn("_k", F.xxhash64(group))
    return left.join(least, (F.col("_k") == F.col("_gk")) & (F.col(group) == F.col("_g"))).drop("_k", "_gk", "_g")


__all__ = ["WS", "WORD", "ascii_lower", "by_bytes", "components", "held_out", "labelled_sample", "py_held_out", "settled", "shared_folder", "table", "with_group_min"]
