"""The engine: SPARQL text in, DataFrames out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators.bindings import Bindings
from .operators.store import QuadStore
from .plans.algebra import Query, show
from .plans.compiler import Counted, Options, Source, compile_query
from .plans.parser import parse


@dataclass
class Outcome:
    """A planned query: its columns, its plan and, once run, its rows and times in milliseconds."""

    query: Query
    bindings: Bindings
    notes: list[str]
    times: dict[str, float]
    places: list[Counted]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(self.query.projection))

    @property
    def algebra(self) -> str:
        return show(self.query.root)

    def plan(self) -> str:
        df = self.bindings.df
        return "\n".join([*self.notes, df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")])

    def counted(self) -> list[tuple[int, str, int | None]]:
        """Runs the query, if made with row_counts, and gives (depth, node, rows) of its tree, patterns and joins in the order in which they were planned.

        Rows are those that really passed: fewer where a LIMIT above stopped early, None where
        Spark didn't need the node. The counts of a node that was run again after a lost executor include both runs.
        """
        began = time.perf_counter()
        whole = self.bindings.df.groupBy().count()
        whole.collect()
        self.times["execute"] = (time.perf_counter() - began) * 1000
        # Only the JVM's plan tells the metrics of nodes that Spark left out from those still to come; an Observation waits for them.
        found = whole._jdf.queryExecution().observedMetrics()
        rows = {p.metric: found.apply(p.metric).getLong(0) for p in self.places if found.contains(p.metric)}
        return [(p.depth, p.what, rows.get(p.metric, p.rows)) for p in self.places]

    def profile(self) -> str:
        """The counted tree as text."""
        return "\n".join(f"{'-' if n is None else n:>12}  {'  ' * depth}{what}" for depth, what, n in self.counted())

    def terms(self) -> DataFrame:
        """The solutions, a term struct for each variable."""
        return self.bindings.df.select(*[self.bindings.col(v).alias(v) for v in self.columns])

    def text(self) -> DataFrame:
        """The solutions as N-Triples texts."""
        return self.bindings.df.select(*[T.ntriples(self.bindings.col(v)).alias(v) for v in self.columns])

    def native(self, **types: str) -> DataFrame:
        """The solutions as plain columns: types name = string, double, bigint, or a number of digits to round to; text if not named."""
        out = []
        for v in self.columns:
            kind, t = types.get(v, "string"), self.bindings.col(v)
            out.append((t["v"] if kind == "string" else F.round(t["n"], int(kind)) if kind.isdigit() else t["n"].cast(kind)).alias(v))
        return self.bindings.df.select(*out)

    def count(self) -> int:
        began = time.perf_counter()
        n = self.bindings.df.count()
        self.times["execute"] = (time.perf_counter() - began) * 1000
        return n

    def collect(self) -> list[tuple[T.Term | None, ...]]:
        began = time.perf_counter()
        rows = [tuple(None if x is None else T.Term(x.k, x.v, x.l, x.d) for x in r) for r in self.terms().collect()]
        self.times["execute"] = (time.perf_counter() - began) * 1000
        return rows

    def table(self, most: int = 20) -> str:
        """An ASCII table of the first solutions: - for unbound, local names for IRIs."""
        rows = list(islice(self.terms().toLocalIterator(), most + 1)) if self.columns else []
        cells = [[short(x) for x in r] for r in rows[:most]]
        heads = [f"?{c}" for c in self.columns]
        widths = [max(len(x) for x in column) for column in zip(heads, *cells)]
        line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip()
        out = [line(heads), "-+-".join("-" * w for w in widths), *map(line, cells)]
        if len(rows) > most:
            out.append(f"... {self.bindings.df.count() - most} more solutions")
        return "\n".join(out)


def short(t) -> str:
    if t is None:
        return "-"
    if t.k == T.IRI:
        return t.v.rstrip("/#").replace("#", "/").rsplit("/", 1)[-1] or t.v
    return f"_:{t.v}" if t.k == T.BLANK else t.v + (f"@{t.l}" if t.l else "")


class Engine:
    """Queries over one source: a QuadStore, or relational tables as virtual triples."""

    def __init__(self, source: Source) -> None:
        self.source = source

    def run(self, text: str, **options) -> Outcome:
        began = time.perf_counter()
        query = parse(text)
        parsed = time.perf_counter()
        bindings, compiler = compile_query(query, self.source, Options(**options))
        return Outcome(query, bindings, compiler.notes, {"parse": (parsed - began) * 1000, "plan": (time.perf_counter() - parsed) * 1000}, compiler.counted)

    def sparql(self, text: str, **options) -> DataFrame:
        return self.run(text, **options).terms()

    def count(self, text: str, **options) -> int:
        return self.run(text, **options).count()


def engine(source: Source) -> Engine:
    return Engine(source)


__all__ = ["Engine", "F", "Outcome", "QuadStore", "SparkSession", "engine"]
