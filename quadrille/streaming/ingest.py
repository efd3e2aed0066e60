"""A folder of N-Triples or N-Quads files as a stream that feeds a saved store.

Queries read complete stores only; this adds nothing to the query language. Each micro-batch is
parsed like any file and appended to the store, in whose manifest the stream's name and the
batch's number stand: a batch that is run again after a failure adds nothing, whether the failure
came before or after its commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parts import Manifest
from ..operators.store import QuadStore
from ..sources.readers import parsed_lines


def stream_into(spark: SparkSession, folder: str, path: str, checkpoint: str, quads: bool = False, scope: str | None = None, name: str | None = None, **trigger) -> StreamingQuery:
    """Start appending new files of `folder` to the store at `path`, which is made if there is none.

    name: the stream's in the manifest, its checkpoint folder by default; trigger: as of
    writeStream.trigger (availableNow=True to drain and stop). Other writers of the same
    store must wait meanwhile: a commit that comes between stops the stream, which then goes on from its checkpoint.
    """
    if Manifest.newest(spark, path) is None:
        QuadStore.empty(spark).save(path)

    def append(batch: DataFrame, number: int) -> None:
        QuadStore.open(spark, path).append(parsed_lines(batch, scope, quads), stream=(name or checkpoint, number))

    lines = spark.readStream.text(folder).select("value", F.input_file_name().alias("name"))
    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streamed_store(spark: SparkSession, path: str) -> QuadStore:
    """What has arrived so far, each quad once."""
    return QuadStore.open(spark, path)
