"""How a saved store lies on disk: parts, their statistics, and manifests that name them.

    path/s/part=<id>/pb=<n>/    quads sorted by predicate and subject
    path/o/part=<id>/pb=<n>/    the same quads, sorted by predicate and object
    path/stats/part=<id>/       of each predicate its counts and sketches of its subjects and objects
    path/manifests/<number>/    the parts of one state of the store, with their counts, files and bytes

pb is a hash bucket of the predicate. What a manifest names is never changed: a commit writes
parts of its own and then a manifest. Statistics of parts are merged where they are asked for, so
a commit reads nothing but what is new. Parts grow geometrically: a new one takes in those before
it that are less than twice its size, so that a store of n quads has some log2(n) parts at
most however it came about, and each quad is written again as often at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..storage import Folder

SCHEMA = f"g {T.TERM}, s {T.TERM}, p {T.TERM}, o {T.TERM}"
BUCKETS = 64
FORMAT_VERSION = 3
#: Sketches of 2^11 entries: distinct counts within some 4 %.
SKETCH = 11
STATS = "p string, n long, t long, s binary, o binary"
#: Bytes of a row group before compression; small enough that a look-up reads little, large enough for scans.
ROW_GROUP = 32 << 20


def bucket(v: Column) -> Column:
    return F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int")


@dataclass
class Part:
    name: str
    quads: int
    triples: int
    buckets: list[int]
    #: Of both orders together.
    files: int
    bytes: int


@dataclass
class Manifest:
    parts: list[Part] = field(default_factory=list)
    #: Of each stream that feeds the store its last batch.
    streams: dict[str, int] = field(default_factory=dict)
    number: int = 0

    @property
    def quads(self) -> int:
        return sum(p.quads for p in self.parts)

    @property
    def triples(self) -> int:
        return sum(p.triples for p in self.parts)

    def write(self, spark: SparkSession, path: str) -> None:
        """As the next one of the path. Of two writers that began with the same manifest the second fails: its folder is there already."""
        content = {"format": "quadrille", "version": FORMAT_VERSION, "parts": [asdict(p) for p in self.parts], "streams": self.streams}
        Folder(spark, f"{path}/manifests/{self.number:09d}").write_new(json.dumps(content))

    @classmethod
    def newest(cls, spark: SparkSession, path: str) -> Manifest | None:
        folder = Folder(spark, f"{path}/manifests")
        numbers = [n for n in folder.names() if n.isdigit()]
        if not numbers:
            return None
        found = json.loads(Folder(spark, f"{path}/manifests/{max(numbers)}").read())
        if found.get("format") != "quadrille" or found.get("version") != FORMAT_VERSION:
            raise ValueError(f"{path} holds no store of version {FORMAT_VERSION}")
        return cls([Part(**p) for p in found["parts"]], found["streams"], int(max(numbers)))


def absorbed(parts: list[Part], size: int) -> tuple[list[Part], list[Part]]:
    """The parts that stay and those, the last ones, that a new part of this size takes in."""
    stay = list(parts)
    while stay and stay[-1].quads < 2 * size:
        size += stay.pop().quads
    return stay, parts[len(stay) :]


def read(spark: SparkSession, path: str, order: str, parts: list[Part]) -> DataFrame:
    """Quads of these parts with pb, one scan for all of them; order: s or o."""
    if not parts:
        return spark.createDataFrame([], f"{SCHEMA}, pb int, part string")
    return spark.read.schema(f"{SCHEMA}, pb int, part string").option("basePath", f"{path}/{order}").parquet(*[f"{path}/{order}/part={p.name}" for p in parts])


def of_predicates(quads: DataFrame, names: list[str]) -> DataFrame:
    """The quads of a saved store with these predicates, from their buckets alone."""
    return quads.where(F.col("pb").isin(*[bucket(F.lit(n)) for n in names]) & F.col("p.v").isin(names))


def write(spark: SparkSession, path: str, quads: DataFrame, compression: str, row_group: int = ROW_GROUP) -> Part | None:
    """Write distinct quads (g, s, p, o) as a part; none if there are none."""
    name = uuid.uuid4().hex

    def put(df: DataFrame, order: str) -> None:
        # statistics of pages stop at 64 bytes by default, which IRIs of one namespace may share
        options = {"compression": compression, "parquet.block.size": row_group, "parquet.columnindex.truncate.length": 256}
        df.sortWithinPartitions("pb", "p.v", f"{order}.v").write.options(**options).partitionBy("pb").parquet(f"{path}/{order}/part={name}")

    # as many tasks as the data ask for, a large bucket in several
    put(quads.select("g", "s", "p", "o", bucket(F.col("p.v")).alias("pb")).hint("rebalance", "pb"), "s")
    if not Folder(spark, f"{path}/s/part={name}").names_like("pb="):
        return None
    written = Part(name, 0, 0, [], 0, 0)
    own = read(spark, path, "s", [written]).drop("part")
    put(own.repartitionByRange("pb", "p.v", "o.v"), "o")  # files of ranges of objects: a look-up reads one or two
    by = own.groupBy(F.col("p.v").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g").isNull()).alias("t"), F.hll_sketch_agg("s.v", SKETCH).alias("s"), F.hll_sketch_agg("o.v", SKETCH).alias("o"))
    by.write.parquet(f"{path}/stats/part={name}")
    total = spark.read.schema(STATS).parquet(f"{path}/stats/part={name}").agg(F.sum("n"), F.sum("t"), F.sort_array(F.collect_set(bucket(F.col("p"))))).first()
    sizes = [Folder(spark, f"{path}/{order}/part={name}").content() for order in "so"]
    return Part(name, total[0], total[1], list(total[2]), sum(n for n, _ in sizes), sum(b for _, b in sizes))


def stats(spark: SparkSession, path: str, parts: list[Part]) -> DataFrame:
    """(p, n, s, o) of each predicate over all parts: quads, and about how many subjects and objects."""
    if not parts:
        return spark.createDataFrame([], "p string, n long, s long, o long")
    rows = spark.read.schema(STATS).parquet(*[f"{path}/stats/part={p.name}" for p in parts])
    return rows.groupBy("p").agg(F.sum("n").alias("n"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in "so"))


def check(spark: SparkSession, path: str, parts: list[Part]) -> None:
    """The parts' files are there, by their number and bytes; no data are read."""
    for p in parts:
        sizes = [Folder(spark, f"{path}/{order}/part={p.name}").content() for order in "so"]
        if (sum(n for n, _ in sizes), sum(b for _, b in sizes)) != (p.files, p.bytes):
            raise ValueError(f"{path} is damaged: part {p.name} should have {p.files} files of {p.bytes} bytes")


def clean(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Delete what this manifest doesn't name."""
    kept = {f"part={p.name}" for p in manifest.parts}
    for order in ("s", "o", "stats"):
        for name in Folder(spark, f"{path}/{order}").names():
            if name.startswith("part=") and name not in kept:
                Folder(spark, f"{path}/{order}/{name}").delete()
    for name in Folder(spark, f"{path}/manifests").names():
        if name.isdigit() and int(name) < manifest.number:
            Folder(spark, f"{path}/manifests/{name}").delete()
