"""A set of quads as a DataFrame (g, s, p, o) of terms; g null is the default graph.

A saved store holds its quads twice, in buckets of the predicate: sorted by subject and sorted by
object (see parts). A pattern with a constant predicate reads one bucket, and min/max statistics
of the flat term fields leave it few row groups and pages of the order in which its
constant lies together.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.algebra import Slot, Triple, Var
from ..storage import settled, shared_folder
from . import bindings as B
from . import parts as P
from .bindings import Bindings
from .parts import SCHEMA, Manifest, bucket
from .rdfs import VOCABULARY, RdfsSchema, RdfsStats, inferences, materialise

#: Predicates whose counts the planner keeps; beyond that the rest share an estimate.
MAX_STATS = 50_000
#: New quads of an append, and their bytes, up to which their keys are broadcast against the buckets that they fall in.
BROADCAST_QUADS, BROADCAST_BYTES = 200_000, 64 << 20


class QuadStore:
    def __init__(self, quads: DataFrame, path: str | None = None, manifest: Manifest | None = None, objects: DataFrame | None = None, distinct: bool = False) -> None:
        """quads (g, s, p, o), repeats allowed unless they are said to be distinct or come from a saved store (path, its manifest, and the quads in the order of objects)."""
        self.spark: SparkSession = quads.sparkSession
        self.bucketed, self.path, self.manifest = path is not None, path, manifest
        self.staged = quads
        self.quads = quads if self.bucketed or distinct else quads.select("g", "s", "p", "o").dropDuplicates()
        self.objects = objects

    # --- making and keeping ---
    @classmethod
    def empty(cls, spark: SparkSession) -> QuadStore:
        return cls(spark.createDataFrame([], SCHEMA))

    @classmethod
    def of(cls, spark: SparkSession, quads: list[tuple]) -> QuadStore:
        """From terms: (s, p, o) or (s, p, o, g)."""
        rows = [(q[3].row() if len(q) > 3 and q[3] is not None else None, *(t.row() for t in q[:3])) for q in quads]
        return cls(spark.createDataFrame(rows, SCHEMA))

    def add(self, more: DataFrame | list[tuple]) -> QuadStore:
        """A new store with these quads too; this one stays as it is."""
        other = more if isinstance(more, DataFrame) else QuadStore.of(self.spark, more).quads
        return QuadStore(self.quads.select("g", "s", "p", "o").unionByName(other.select("g", "s", "p", "o")))

    def cached(self) -> QuadStore:
        """Held in memory, spilling to disk; for stores that many queries read."""
        self.quads, self.objects = self.quads.persist(StorageLevel.MEMORY_AND_DISK), None
        return self

    def save(self, path: str, compression: str = "zstd", row_group: int = P.ROW_GROUP) -> QuadStore:
        """Write the store and open it; compression: zstd (compressed) or none (plain).

        path may be where this or another store was opened from: that one's files stay until vacuum.
        """
        before = Manifest.newest(self.spark, path)
        part = P.write(self.spark, path, self.quads, compression, row_group)
        streams = self.manifest.streams if self.manifest else {}
        Manifest([part] if part else [], streams, (before.number if before else 0) + 1).write(self.spark, path)
        return QuadStore.open(self.spark, path)

    def append(self, more: DataFrame | list[tuple], compression: str = "zstd", row_group: int = P.ROW_GROUP, stream: tuple[str, int] | None = None, rdfs: bool = False) -> QuadStore:
        """The store at this one's path, as it is now, with these quads too.

        What is written is what is new and, now and then, small parts that grow together; what
        is read to leave out known quads is the buckets of the new ones' predicates, there the range
        of their subjects. stream: a stream's name and the number of its batch; one that the
        store holds already adds nothing. rdfs: what follows by RDFS from the new quads, for a store
        whose own inferences are stored; unless the schema changes, that reads of the store only
        the buckets of the inferred predicates. Of two commits at one time the later one is an error.
        """
        if self.path is None:
            raise ValueError("only a saved store can be appended to")
        manifest = Manifest.newest(self.spark, self.path)
        if stream and manifest.streams.get(stream[0], -1) >= stream[1]:
            return QuadStore.open(self.spark, self.path)
        other = QuadStore(more) if isinstance(more, DataFrame) else QuadStore.of(self.spark, more)
        fresh = settled(other.quads.withColumn("pb", bucket(F.col("p.v"))))
        length = sum((F.coalesce(F.octet_length(F.col(f"{c}.{f}")), F.lit(0)) for c in "gspo" for f in "vld"), F.lit(0))
        n, size, touched, *ranges = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0)), F.collect_set("pb"), *(f(f"{c}.v") for c in "sp" for f in (F.min, F.max))).first()
        streams = manifest.streams | ({stream[0]: stream[1]} if stream else {})
        parts = manifest.parts
        if n:
            fresh = self._unknown(fresh, parts, sorted(touched), ranges, n <= BROADCAST_QUADS and size <= BROADCAST_BYTES)
            if rdfs:
                fresh = settled(fresh)
                held = P.read(self.spark, self.path, "s", parts)
                few = lambda names: P.of_predicates(held, names).select("g", "s", "p", "o").unionByName(fresh)
                added, _, _ = inferences(held.select("g", "s", "p", "o").unionByName(fresh), settled, fresh, few)
                fresh = fresh.unionByName(added.select(F.lit(None).cast(T.TERM).alias("g"), "s", "p", "o"))
            stay, small = P.absorbed(parts, n)
            part = P.write(self.spark, self.path, fresh.unionByName(P.read(self.spark, self.path, "s", small).select("g", "s", "p", "o")) if small else fresh, compression, row_group)
            parts = [*stay, part] if part else parts
        Manifest(parts, streams, manifest.number + 1).write(self.spark, self.path)
        return QuadStore.open(self.spark, self.path)

    def _unknown(self, fresh: DataFrame, parts: list[P.Part], touched: list[int], ranges: list[str], small: bool) -> DataFrame:
        """Those of the new quads that the store lacks."""
        held = P.read(self.spark, self.path, "s", [p for p in parts if {*p.buckets} & {*touched}])
        held = held.where(F.col("pb").isin(touched) & F.col("s.v").between(*ranges[:2]) & F.col("p.v").between(*ranges[2:]))
        key = lambda df, to: df.select("g", "s", "p", "o", F.struct(*[F.col(f"{c}.{f}").alias(f"{c}{f}") for c in "spo" for f in "kvld"], *[F.coalesce(F.col(f"g.{f}").cast("string"), F.lit("-")).alias(f"g{f}") for f in "kvld"]).alias(to))
        fresh, held = key(fresh, "new"), key(held, "old").select("old")
        if small:  # the buckets stream past the new quads, and only those that are met again are shuffled
            held = held.join(F.broadcast(fresh.select("new")), F.col("old") == F.col("new"), "left_semi")
        return fresh.join(held, F.col("new") == F.col("old"), "left_anti").select("g", "s", "p", "o")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuadStore:
        manifest = Manifest.newest(spark, path)
        if manifest is None:
            raise ValueError(f"{path} holds no store")
        P.check(spark, path, manifest.parts)
        return cls(P.read(spark, path, "s", manifest.parts), path, manifest, P.read(spark, path, "o", manifest.parts))

    @classmethod
    def vacuum(cls, spark: SparkSession, path: str) -> None:
        """Delete what the newest manifest doesn't name; stores opened before can't be read any more."""
        P.clean(spark, path, cls.open(spark, path).manifest)

    # --- counts ---
    def triple_count(self) -> int:
        return self.manifest.triples if self.manifest else self.quads.where("g is null").count()

    def quad_count(self) -> int:
        return self.manifest.quads if self.manifest else self.quads.count()

    def staged_count(self) -> int:
        """Quads that were given, repeats included."""
        return self.staged.count()

    def size_bytes(self) -> int:
        """Of a saved store its files' bytes, else what Spark expects its quads to take."""
        if self.path:
            return sum(p.bytes for p in self.manifest.parts)
        return int(str(self.quads._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def named_graphs(self) -> list[T.Term]:
        return [T.Term(r.g.k, r.g.v, r.g.l, r.g.d) for r in self.graphs().orderBy(T.sort_key(F.col("g"))).collect()]

    def named_graph_count(self) -> int:
        return self.graphs().count()

    def count(self, s: T.Term | None = None, p: T.Term | None = None, o: T.Term | None = None, g: T.Term | None = None) -> int:
        """Exact count of a pattern; None is any. Without g the default graph counts."""
        return self._matching({"s": s, "p": p, "o": o}, g).count()

    def terms(self) -> DataFrame:
        """Every distinct term once, as (term)."""
        parts = [self.quads.select(F.col(c).alias("term")).where("term is not null") for c in ("g", "s", "p", "o")]
        return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).distinct()

    # --- reading patterns ---
    def _matching(self, constants: dict[str, T.Term | None], graph: Slot | None, by: str = "s") -> DataFrame:
        """by: s or o, the position that few values will be asked of where none is constant."""
        by_object = self.objects is not None and constants.get("s") is None and (constants.get("o") is not None or by == "o")
        df = self.objects if by_object else self.quads
        if graph is None:
            df = df.where("g is null")
        elif isinstance(graph, Var):
            df = df.where("g is not null")
        else:
            constants = {**constants, "g": graph}
        for name, t in constants.items():
            if t is not None:
                # plain fields one by one, so that they reach the scan
                df = df.where((F.col(f"{name}.v") == t.v) & (F.col(f"{name}.k") == t.k))
                if t.k == T.LITERAL:
                    df = df.where((F.col(f"{name}.l") == t.l) & (F.col(f"{name}.d") == t.d))
                if name == "p" and self.bucketed:
                    df = df.where(F.col("pb") == bucket(F.lit(t.v)))
        return df

    def scan(self, triple: Triple, graph: Slot | None, by: str | None = None) -> Bindings:
        slots = dict(zip("spo", triple.slots())) | ({"g": graph} if isinstance(graph, Var) else {})
        df = self._matching({n: x if isinstance(x, T.Term) else None for n, x in slots.items() if n != "g"}, graph, "o" if by is not None and triple.o == Var(by) and triple.s != Var(by) else "s")
        columns = {}
        for name, x in slots.items():
            if isinstance(x, Var):
                if x.name in columns:
                    df = df.where(columns[x.name] == F.col(name))
                else:
                    columns[x.name] = F.col(name)
        return B.fresh(df, columns, set(columns))

    def star(self, triples: list[Triple], graph: Slot | None) -> list[tuple[list[Triple], Bindings]]:
        return [([t], self.scan(t, graph)) for t in triples]

    @cached_property
    def stats(self) -> dict[str, tuple[int, int, int]]:
        """Per predicate: quads, subjects, objects (the last two estimated). Merged from those of a saved store's parts, else one pass; kept with the store."""
        if self.manifest:
            by = P.stats(self.spark, self.path, self.manifest.parts)
        else:
            by = self.quads.groupBy(F.col("p.v").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s.v").alias("s"), F.approx_count_distinct("o.v").alias("o"))
        return {r.p: (r.n, max(1, r.s), max(1, r.o)) for r in by.orderBy(F.desc("n")).limit(MAX_STATS).collect()}

    def cardinality(self, triple: Triple, graph: Slot | None) -> float:
        stats = self.stats
        if isinstance(triple.p, T.Term):
            n, s, o = stats.get(triple.p.v, (0, 1, 1))
        else:
            n = sum(x[0] for x in stats.values())
            s, o = max([1, *(x[1] for x in stats.values())]), max([1, *(x[2] for x in stats.values())])
        return n / (s if isinstance(triple.s, T.Term) else 1) / (o if isinstance(triple.o, T.Term) else 1)

    def graphs(self) -> DataFrame:
        return self.quads.where("g is not null").select("g").distinct()

    # --- inference and output ---
    def rdfs_schema(self) -> RdfsSchema:
        return RdfsSchema.collect(P.of_predicates(self.quads, VOCABULARY) if self.bucketed else self.quads)

    def materialise_rdfs(self) -> tuple[QuadStore, RdfsStats]:
        data, stats = materialise(self.quads.select("g", "s", "p", "o"), settled, stored=self.bucketed)
        return QuadStore(data, distinct=True), stats

    def ntriples(self) -> DataFrame:
        """The default graph as lines (value)."""
        df = self.quads.where("g is null")
        return df.select(F.concat_ws(" ", *(T.ntriples(F.col(c)) for c in "spo"), F.lit(".")).alias("value"))

    def nquads(self) -> DataFrame:
        """All graphs as lines (value)."""
        return self.quads.select(F.concat_ws(" ", *(T.ntriples(F.col(c)) for c in "spog"), F.lit(".")).alias("value"))

    def write_ntriples(self, path: str) -> None:
        self.ntriples().write.mode("overwrite").text(path)

    def write_nquads(self, path: str) -> None:
        self.nquads().write.mode("overwrite").text(path)


__all__ = ["SCHEMA", "QuadStore", "settled", "shared_folder"]
