"""The folder that driver and executors share, and frames cut from their lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage. A frame has the value of when it was made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests, one machine) gets a temporary folder; on a
    cluster there is no folder to guess, and that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and cut from its lineage.

    A checkpoint keeps the size that Spark estimated for its plan, and estimates of joins are
    products; a frame made anew from its rows has none, so they can't grow from round to
    round of a loop. The public API has no way to do that: this is the one place that uses the JVM's.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled isn't read again
    try:
        own = df.select("*")
    finally:
        spark.conf.set(CLEANUP, before)
    kept = own.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


class Folder:
    """A path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Of what lies in it; none if it isn't there."""
        return [s.getPath().getName() for s in self.system.listStatus(self.path)] if self.system.exists(self.path) else []

    def size(self) -> int:
        """Bytes of all files below."""
        return self.system.getContentSummary(self.path).getLength() if self.system.exists(self.path) else 0

    def names_like(self, start: str) -> list[str]:
        return [n for n in self.names() if n.startswith(start)]

    def content(self) -> tuple[int, int]:
        """Data files below, and their bytes."""
        count = size = 0
        found = self.system.listFiles(self.path, True) if self.system.exists(self.path) else None
        while found is not None and found.hasNext():
            one = found.next()
            if not one.getPath().getName().startswith(("_", ".")):
                count, size = count + 1, size + one.getLen()
        return count, size

    def write_new(self, text: str) -> None:
        """A small file at this path, whole or not at all; an error if the path is taken."""
        hidden = self.spark._jvm.org.apache.hadoop.fs.Path(self.path.getParent(), f".{uuid.uuid4().hex}")
        out = self.system.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        if self.system.exists(self.path) or not self.system.rename(hidden, self.path):
            self.system.delete(hidden, False)
            raise FileExistsError(f"{self.path} was written meanwhile")

    def read(self) -> str:
        """The text of a small file."""
        source = self.system.open(self.path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def delete(self) -> None:
        self.system.delete(self.path, True)
