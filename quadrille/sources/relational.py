"""Relational tables as virtual triples (W3C Direct Mapping), without making any.

A row is the subject <base/table/key>, a column the predicate <base/table#column>, a foreign
key's object the subject of its row, and every row is of the class <base/table>. Triple
patterns on one subject variable whose predicates are columns of one table fold to a single
scan of it, so a star costs one read of the columns it names and no join. The number of a
numeric literal stays the native column: filters and sums reach the scan as such.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import bindings as B
from ..operators.bindings import Bindings
from ..operators.rdfs import RdfsSchema
from ..plans.algebra import Slot, Triple, Var

BASE = "http://d/"
_TYPES = {"string": T.STRING, "int": T.INTEGER, "bigint": T.INTEGER, "smallint": T.INTEGER, "tinyint": T.INTEGER, "double": T.DOUBLE, "float": T.DOUBLE, "boolean": T.BOOLEAN, "timestamp": T.DATETIME, "timestamp_ntz": T.DATETIME, "date": T.XSD + "date"}
NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")
#: Triples that one task makes of a table's rows, about.
TASK_TRIPLES = 1 << 18


@dataclass(frozen=True)
class Table:
    """key: the columns that name a row; none: a hash of the whole row names it."""

    name: str
    key: tuple[str, ...]
    references: dict[str, str] = field(default_factory=dict)


#: The test tables. lineitem has no key among its columns.
TABLES = (
    Table("region", ("r_regionkey",)),
    Table("nation", ("n_nationkey",), {"n_regionkey": "region"}),
    Table("customer", ("c_custkey",), {"c_nationkey": "nation"}),
    Table("supplier", ("s_suppkey",), {"s_nationkey": "nation"}),
    Table("part", ("p_partkey",)),
    Table("orders", ("o_orderkey",), {"o_custkey": "customer"}),
    Table("lineitem", (), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Table("events", ("event_id",)),
    Table("documents", ("doc_id",)),
    Table("labels", ("doc_id",), {"doc_id": "documents"}),
    Table("pages", ("page_id",)),
    Table("conversations", ("conv_id", "turn")),
    Table("benchmark", ("item_id",)),
)


def _canonical(text: str) -> bool:
    """Whether a text is what a whole number of a column is written as."""
    return re.match(r"(?:0|-?[1-9][0-9]{0,18})\Z", text) is not None


class RelationalSource:
    """A Source over Parquet tables in one folder; all of them are the default graph."""

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[Table, ...] = TABLES, base: str = BASE) -> None:
        self.spark, self.folder, self.base = spark, folder, base
        self.tables = {t.name: t for t in tables}
        self._frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def columns(self, name: str) -> dict[str, str]:
        """Mapped columns and their Spark types; arrays have no literal form and stay out."""
        return {c: t for c, t in self.frame(name).dtypes if t in _TYPES}

    # --- terms of a row ---
    def subject_iri(self, table: Table) -> Column:
        if table.key:
            key = F.concat_ws("/", *(F.col(c).cast("string") for c in table.key))
        else:
            key = F.sha2(F.to_json(F.struct(*self.columns(table.name))), 256)
        return F.concat(F.lit(f"{self.base}{table.name}/"), key)

    def rows_of(self, table: Table, subject: Slot) -> DataFrame:
        """The table's rows that may have this subject: the key in a constant's IRI is compared with the native columns, so it reaches the scan."""
        df = self.frame(table.name)
        if not isinstance(subject, T.Term):
            return df
        head = f"{self.base}{table.name}/"
        if subject.k != T.IRI or not subject.v.startswith(head):
            return df.where(F.lit(False))
        parts = subject.v[len(head) :].split("/", len(table.key) - 1) if table.key else []
        if len(parts) != len(table.key):
            return df.where(F.lit(False))
        for column, part in zip(table.key, parts):
            kind = self.columns(table.name).get(column)
            if kind in NUMBERS[:4]:
                bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind]
                fits = _canonical(part) and -(1 << bits - 1) <= int(part) < 1 << bits - 1
                df = df.where(F.col(column) == F.lit(int(part)).cast(kind) if fits else F.lit(False))
            elif kind == "string" and len(table.key) == 1:
                df = df.where(F.col(column) == part)
        return df

    def subject(self, table: Table) -> Column:
        return T.make(F.lit(T.IRI), self.subject_iri(table))

    def object(self, table: Table, column: str) -> Column:
        """The column's term, for rows where it isn't null: without a test for null, filters on it reach the scan."""
        c, kind = F.col(column), self.columns(table.name)[column]
        if column in table.references:
            return T.make(F.lit(T.IRI), F.concat(F.lit(f"{self.base}{table.references[column]}/"), c.cast("string")))
        text = c.cast("string")
        if kind in ("timestamp", "timestamp_ntz"):
            text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        number = c.cast("double") if kind in NUMBERS else None
        return T.make(F.lit(T.LITERAL), text, None, F.lit(_TYPES[kind]), number)

    def _column(self, p: Slot) -> tuple[Table, str] | None:
        """The table and column that a constant predicate names; the column rdf:type's class stands in `o`."""
        if isinstance(p, T.Term) and p.v.startswith(self.base) and "#" in p.v:
            name, _, column = p.v[len(self.base) :].partition("#")
            if name in self.tables and column in self.columns(name):
                return self.tables[name], column
        return None

    def _class(self, t: Triple) -> Table | None:
        if isinstance(t.p, T.Term) and t.p.v == T.TYPE and isinstance(t.o, T.Term) and t.o.v.startswith(self.base):
            return self.tables.get(t.o.v[len(self.base) :])
        return None

    # --- patterns ---
    def star(self, triples: list[Triple], graph: Slot | None) -> list[tuple[list[Triple], Bindings]]:
        groups: dict[object, list[Triple]] = {}
        for i, t in enumerate(triples):
            found = self._column(t.p)
            table = found[0] if found else self._class(t)
            key = (t.s, table.name) if table and isinstance(t.s, Var) and graph is None else i
            groups.setdefault(key, []).append(t)
        return [(ts, self._fold(self.tables[key[1]], ts) if isinstance(key, tuple) else self.scan(ts[0], graph)) for key, ts in groups.items()]

    def _fold(self, table: Table, triples: list[Triple], of: Slot | None = None) -> Bindings:
        """One scan for patterns on one subject (`of`: a constant one). A row has one value of each column, so no join is needed."""
        df = self.rows_of(table, of)
        subject = triples[0].s.name
        columns = {subject: self.subject(table)}
        keys: B.Keys = {}
        if len(table.key) == 1 and (key := self.key(table.name, table.name, table.key[0])):
            keys[subject] = key
        for t in triples:
            found = self._column(t.p)
            if not found:
                continue  # the class holds of every row
            name = found[1]
            df = df.where(F.col(name).isNotNull())
            if isinstance(t.o, T.Term):
                df = df.where(self._is(table, name, t.o))
            elif t.o.name in columns:
                df = df.where(columns[t.o.name] == self.object(table, name))
            else:
                columns[t.o.name] = self.object(table, name)
                if name in table.references and (key := self.key(table.references[name], table.name, name)):
                    keys[t.o.name] = key
        return replace(B.fresh(df, columns, set(columns), keys), many=frozenset(columns) - {subject} - {t.o.name for t in triples if isinstance(t.o, Var) and self._names_row(table, t)})

    def _names_row(self, table: Table, t: Triple) -> bool:
        found = self._column(t.p)
        return found is not None and table.key == (found[1],)

    def key(self, domain: str, table: str, column: str) -> tuple[str, Column] | None:
        """A whole number that names a row of `domain`, from the table's column: joins on it need not build the subjects' texts."""
        kinds = [self.columns(t).get(c) for t, c in ((table, column), *((domain, k) for k in self.tables[domain].key))]
        whole = len(kinds) == 2 and all(k in NUMBERS[:4] for k in kinds)
        return (f"{self.base}{domain}", F.col(column).cast("bigint")) if whole else None

    def _is(self, table: Table, column: str, t: T.Term) -> Column:
        """The column's term is t: as a comparison of the native column where its text is canonical."""
        kind = self.columns(table.name)[column]
        if column in table.references:
            head = f"{self.base}{table.references[column]}/"
            if t.k != T.IRI or not t.v.startswith(head):
                return F.lit(False)
            return F.col(column) == F.lit(t.v[len(head) :]).try_cast(kind)
        if t.k != T.LITERAL or t.d != _TYPES[kind] or t.l:
            return F.lit(False)
        if kind == "string":
            return F.col(column) == t.v
        if kind in NUMBERS[:4]:
            return (F.col(column) == int(t.v)) if _canonical(t.v) else F.lit(False)
        return self.object(table, column)["v"] == t.v

    def scan(self, triple: Triple, graph: Slot | None, by: str | None = None) -> Bindings:
        """One pattern alone: a table where the predicate names its column, else the triples of every table that may match."""
        if graph is not None:
            return self._none(triple, graph)
        found = self._column(triple.p)
        if found or self._class(triple):
            table = found[0] if found else self._class(triple)
            if isinstance(triple.s, Var):
                return self._fold(table, [triple])
            inner = self._fold(table, [Triple(Var("_subject"), triple.p, triple.o)], triple.s)
            kept = inner.filtered((inner.col("_subject")["v"] == triple.s.v) & (F.lit(triple.s.k) == T.IRI))
            return B.fresh(kept.df, {v: kept.col(v) for v in triple.variables()}, set(triple.variables()))
        if isinstance(triple.p, T.Term) and triple.p.v != T.TYPE:
            return self._none(triple, graph)
        parts = [p for t in self.tables.values() for p in self._triples(t, triple)]
        if not parts:
            return self._none(triple, graph)
        df = parts[0]
        for p in parts[1:]:
            df = df.unionAll(p)
        columns: dict[str, Column] = {}
        for name, x in zip("spo", triple.slots()):
            if isinstance(x, T.Term):
                df = df.where((F.col(f"{name}.v") == x.v) & (F.col(f"{name}.k") == x.k) & (F.col(f"{name}.l") == x.l) & (F.col(f"{name}.d") == x.d))
            elif x.name in columns:
                df = df.where(columns[x.name] == F.col(name))
            else:
                columns[x.name] = F.col(name)
        return B.fresh(df, columns, set(columns))

    def _dealt(self, table: Table) -> DataFrame:
        """The table's rows, dealt to tasks that make a bounded number of triples each, however few files and row groups hold them. Equal rows stay together."""
        columns = list(self.columns(table.name))
        tasks = -(-int(self.rows(table.name)) * (len(columns) + 1) // TASK_TRIPLES)
        df = self.frame(table.name).select(*columns)
        return df.repartition(tasks, F.xxhash64(*columns)) if tasks > 1 else df

    def _triples(self, table: Table, t: Triple, df: DataFrame | None = None) -> list[DataFrame]:
        if not self._present(table.name):
            return []
        df, s = self.rows_of(table, t.s) if df is None else df, self.subject(table).alias("s")
        out = [df.select(s, T.constant(T.iri(T.TYPE)).alias("p"), T.constant(T.iri(self.base + table.name)).alias("o"))]
        if not isinstance(t.p, T.Term):
            pairs = F.explode(F.array(*[F.struct(T.constant(T.iri(f"{self.base}{table.name}#{c}")).alias("p"), F.when(F.col(c).isNotNull(), self.object(table, c)).alias("o")) for c in self.columns(table.name)]))
            out.append(df.select(s, pairs.alias("x")).select("s", "x.p", "x.o").where("o is not null"))
        return out

    def triples(self, names: tuple[str, ...]) -> DataFrame:
        """All triples of these tables as (s, p, o). They are about to be told apart or shuffled: what a task holds for that is bounded by its rows."""
        x = Triple(Var("s"), Var("p"), Var("o"))
        parts = [p for n in names if self._present(n) for p in self._triples(self.tables[n], x, self._dealt(self.tables[n]))]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionAll(p)
        return df

    def _present(self, name: str) -> bool:
        try:
            return bool(self.frame(name).columns)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise

    def _none(self, triple: Triple, graph: Slot | None) -> Bindings:
        names = list(dict.fromkeys([*triple.variables(), *([graph.name] if isinstance(graph, Var) else [])]))
        return B.fresh(self.spark.range(0), {v: T.unbound() for v in names}, set(names))

    # --- for the planner ---
    @cached_property
    def _rows(self) -> dict[str, float]:
        """Rows by the Parquet footers of each table (a count reads no column)."""
        return {}

    def rows(self, name: str) -> float:
        if name not in self._rows:
            self._rows[name] = float(self.frame(name).count())
        return self._rows[name]

    def cardinality(self, triple: Triple, graph: Slot | None) -> float:
        found = self._column(triple.p)
        table = found[0] if found else self._class(triple)
        if table is None:
            return 1e15
        n = self.rows(table.name)
        if isinstance(triple.s, T.Term):
            return 1.0
        return n / 100 if isinstance(triple.o, T.Term) and found else n

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([], f"g {T.TERM}")

    def rdfs_schema(self) -> RdfsSchema:
        return RdfsSchema({}, {}, {}, {})
