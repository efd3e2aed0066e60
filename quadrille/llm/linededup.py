"""Dropping lines that many documents share, in DataFrame functions only.

Line hashes are range-partitioned with the document as second key, so that a line of a
third of all documents spreads over many partitions, and sorted there by document and
position: the first occurrence of a line in each document streams past and is counted,
partition by partition, before the counts of a line meet. Texts take no part in this.
The result is a keep bitmap for each document, compressed to runs of kept lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, ascii_lower, settled


def lost_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs (doc_id, text) to (doc_id, th, lost), for documents that lose lines.

    A line's key is the line without white space at its ends and with A-Z in lower case.
    Keys of at least `min_chars` code points in at least `min_docs` documents are dropped
    but for the document of the largest id that holds them, which keeps all its lines of
    that key. lost: the positions of the lines, from 0. th is the text's xxhash64;
    (doc_id, th) names the document. Equal rows count as a document each and lose the
    same lines; rows of one id with other texts are other documents, and all of them keep a line
    if theirs is the largest id. A null id is below all others; a null text is one empty
    line. Keys are told apart by two 64-bit hashes of different seeds.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("did"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    base = base.withColumn("row", F.monotonically_increasing_id())  # before the lines: a number for each document
    lines = base.select("did", "th", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.where(F.octet_length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(WS))).where(F.char_length("key") >= min_chars)
    keyed = keyed.withColumn("key", ascii_lower(F.col("key")))
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "did", "th", "row", "pos")
    hashed = settled(hashed)  # the range partitioner samples its input: texts aren't split and hashed again for that
    dealt = hashed.repartitionByRange("h1", "h2", "did").sortWithinPartitions("h1", "h2", "did", "row", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "did", "row").orderBy("pos")) == 1
    dealt = settled(dealt.select("h1", "h2", "did", "th", "pos", first.cast("int").alias("first")))  # read twice: counted and looked up
    counts = dealt.groupBy("h1", "h2").agg(F.sum("first").alias("n"), F.max("did").alias("last"))
    # the derived key makes Spark exchange both sides anew, so it can split the rows of a hot line
    common = counts.where(F.col("n") >= min_docs).select(F.xxhash64("h1", "h2").alias("hk"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "last")
    dealt = dealt.select(F.xxhash64("h1", "h2").alias("hk"), "h1", "h2", "did", "th", "pos")
    hit = dealt.join(common, (dealt["hk"] == common["hk"]) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    lost = hit.where(~F.col("did").eqNullSafe(F.col("last"))).groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    return lost.select(F.col("did").alias("doc_id"), "th", "lost")


def kept_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and kept_text; see lost_lines.

    keep_runs, the document's keep bitmap in runs: array of (first, n), lines from 0; null
    where all lines stay.
    """
    lost = lost_lines(docs.select("doc_id", "text"), **options).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("lost").alias("_lost"))
    keyed = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_id", F.col("doc_id").cast("bigint"))
    both = keyed.join(lost, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    ends = F.concat(F.array(F.lit(-1)), "_lost", F.array(F.size(lines)))
    # one lambda argument for the ends and one for the lines, so that neither is made again for each run
    gaps = F.transform(F.array(ends), lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.struct((e[i] + 1).alias("first"), (e[i + 1] - e[i] - 1).alias("n"))))[0]
    runs = F.when(F.col("_lost").isNotNull(), F.filter(gaps, lambda r: r["n"] > 0))
    both = both.withColumn("keep_runs", runs).withColumn("n_lines", F.size(lines).cast("bigint")).withColumn("n_dropped", F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint"))
    joined = F.transform(F.array(lines), lambda x: F.array_join(F.transform("keep_runs", lambda r: F.array_join(F.slice(x, r["first"] + 1, r["n"]), "\n")), "\n"))[0]
    both = both.withColumn("kept_text", F.when(F.col("_lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(joined))
    return both.drop("_d", "_t", "_lost", "_th", "_id")


def without_shared_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with only the lines kept, in their own columns; n_chars follows the text.

    A document that loses no line keeps its text as it is, null included; one that loses
    all its lines is left with the empty text.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = kept_lines(docs.select("doc_id", "text", F.struct(*others).alias("_row")), **options)
    same = F.col("keep_runs").isNull()
    out = {c: F.col("_row")[c] for c in others} | {"text": F.when(same, F.col("text")).otherwise(F.col("kept_text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(same, out["n_chars"]).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[out[c].alias(c) for c in docs.columns])
