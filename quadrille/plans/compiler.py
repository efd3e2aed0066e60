"""SPARQL algebra to one Spark DataFrame plan.

The compiler does what Catalyst can't know: the order of triple patterns, folding of
patterns on one subject, joins where a variable may be unbound, filters of nested groups
that look outside, RDFS expansion, and OPTIONAL with !BOUND as an anti-join. All else,
pushdown, pruning, join strategy and spilling, is left to Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import bindings as B
from ..operators.bindings import Bindings
from ..operators.rdfs import RdfsSchema
from .algebra import Aggregate, Bgp, Distinct, Expr, Filter, Graph, Group, Join, LeftJoin, Node, Op, OrderBy, Project, Query, Slice, Slot, Triple, Union, Var, expr_variables, show
from .expressions import Value, compile_expr, truth


@dataclass(frozen=True)
class Options:
    #: Keep triple patterns in their written order.
    naive_join_order: bool = False
    #: True: joins on variables are asked to sort and merge; False: to hash; None: Spark chooses by what it knows of the sides.
    enable_merge_join: bool | None = None
    #: Apply the RDFS rules while reading, without storing what follows from them.
    rdfs_query_time: bool = False
    #: Joined patterns of at most so many rows are run while the plan is made, where the next pattern has `lookup_from` rows or more by
    #: its statistics; that one then reads only what their values can meet. 0: never.
    lookup_rows: int = 1_000
    lookup_from: int = 250_000
    #: Count the rows that each node, pattern and join of patterns gives, for `Outcome.counted`.
    row_counts: bool = False


class Source(Protocol):
    """Where triples come from."""

    spark: object

    def scan(self, triple: Triple, graph: Slot | None, by: str | None = None) -> Bindings:
        """One pattern's bindings; by: a variable that few values will be asked of."""

    def star(self, triples: list[Triple], graph: Slot | None) -> list[tuple[list[Triple], Bindings]]:
        """Groups of these patterns, each answered by one scan."""

    def cardinality(self, triple: Triple, graph: Slot | None) -> float: ...

    def graphs(self) -> DataFrame:
        """Named graphs as (g)."""

    def rdfs_schema(self) -> RdfsSchema: ...


#: Entailed classes or properties up to which each gets a scan of its own; more are asked for in one scan.
FEW_SCANS = 32
#: Of those in one scan, how many are broadcast.
BROADCAST_TERMS = 200_000


@dataclass
class Counted:
    """A place in the tree whose rows are counted, by the name of its metric; or whose rows are known."""

    depth: int
    what: str
    metric: str
    rows: int | None = None


class Compiler:
    def __init__(self, source: Source, options: Options = Options()) -> None:
        self.source, self.options = source, options
        self.notes: list[str] = []
        self.counted: list[Counted] = []
        self.depth = 0
        self.schema = source.rdfs_schema() if options.rdfs_query_time else None

    # --- the tree ---
    def compile(self, node: Node, graph: Slot | None = None) -> Bindings:
        if not self.options.row_counts:
            return self.compiled(node, graph)
        place = self.place(show(node).splitlines()[0])
        self.depth += 1
        found = self.compiled(node, graph)
        self.depth -= 1
        return observed(found, place)

    def place(self, what: str) -> Counted:
        self.counted.append(Counted(self.depth, what, f"rows {len(self.counted)}"))
        return self.counted[-1]

    def observe(self, found: Bindings, what: str) -> Bindings:
        return observed(found, self.place(what)) if self.options.row_counts else found

    def compiled(self, node: Node, graph: Slot | None) -> Bindings:
        match node:
            case Bgp():
                return self.bgp(node, graph)
            case Join():
                return self.join(node, graph)
            case LeftJoin():
                left, right = self.compile(node.left, graph), self.compile(node.right, graph)
                return B.left_join(left, right, self.condition(node))
            case Union():
                return B.union(self.compile(node.left, graph), self.compile(node.right, graph))
            case Filter():
                return self.filter(node, graph)
            case Graph():
                return self.graph(node)
            case Group():
                return self.group(node, graph)
            case OrderBy():
                child = self.compile(node.child, graph)
                return Bindings(child.df.orderBy(*self.sort_keys(node, child)), child.names, child.definite)
            case Project():
                return project(self.compile(node.child, graph), node.names)
            case Distinct():
                return self.distinct(node, graph)
            case Slice():
                child = self.compile(node.child, graph)
                df = child.df.offset(node.offset) if node.offset else child.df
                return Bindings(df if node.limit is None else df.limit(node.limit), child.names, child.definite)
        raise TypeError(node)

    def condition(self, node: LeftJoin) -> B.Condition:
        def of(scope: dict[str, Column]) -> Column | None:
            found = None
            for c in node.conditions:
                one = truth(c, scope)
                found = one if found is None else found & one
            return found

        return of

    def join(self, node: Join, graph: Slot | None) -> Bindings:
        """A filter of the right group on variables bound only outside of it holds for the join."""
        left, inner, outside = self.compile(node.left, graph), node.right, []
        kept: list[Expr] = []
        while isinstance(inner, Filter):
            kept.insert(0, inner.condition)
            inner = inner.child
        right = self.compile(inner, graph)
        for c in kept:
            used = set(expr_variables(c))
            if used - set(right.names) and used & (set(left.names) - set(right.names)):
                outside.append(c)
            else:
                right = right.filtered(truth(c, right.scope()))
        both = B.join(left, right, self.hint(left, right))
        for c in outside:
            both = both.filtered(truth(c, both.scope()))
        return both

    def hint(self, a: Bindings, b: Bindings) -> str | None:
        return {None: None, True: "merge", False: "shuffle_hash"}[self.options.enable_merge_join]

    def filter(self, node: Filter, graph: Slot | None) -> Bindings:
        inner, missing = node.child, node.condition
        if isinstance(inner, LeftJoin) and isinstance(missing, Op) and missing.name == "!":
            call = missing.args[0]
            if getattr(call, "name", "") == "BOUND" and len(names := expr_variables(call)) == 1:
                left, right = self.compile(inner.left, graph), self.compile(inner.right, graph)
                if names[0] not in left.names and names[0] in right.definite:
                    self.notes.append(f"anti-join: OPTIONAL without ?{names[0]}")
                    return B.anti_join(left, right, self.condition(inner))
                child = B.left_join(left, right, self.condition(inner))
                return child.filtered(truth(missing, child.scope()))
        child = self.compile(inner, graph)
        return child.filtered(truth(missing, child.scope()))

    def graph(self, node: Graph) -> Bindings:
        found = self.compile(node.child, node.name)
        if isinstance(node.name, Var) and node.name.name not in found.definite:
            names = self.source.graphs()
            return B.join(B.fresh(names, {node.name.name: F.col("g")}, {node.name.name}), found)
        return found

    # --- triple patterns ---
    def bgp(self, node: Bgp, graph: Slot | None) -> Bindings:
        if not node.triples:
            return Bindings(self.source.spark.range(1).select(), {}, frozenset())
        if self.schema is not None:
            parts = [([t], self.entailed(t, graph)) for t in node.triples]
        else:
            parts = self.source.star(list(node.triples), graph)
        parts = self.ordered(parts, graph)
        found = self.observe(parts[0][1], _patterns(parts[0][0]))
        for triples, more in parts[1:]:
            found, more = self.looked_up(found, triples, more, graph)
            more = self.observe(more, _patterns(triples))
            found = self.observe(B.join(found, more, self.hint(found, more)), "joined")
        return found

    def looked_up(self, found: Bindings, triples: list[Triple], more: Bindings, graph: Slot | None) -> tuple[Bindings, Bindings]:
        """found with its rows at hand, and the next patterns' bindings with the values of a shared variable only, where few rows meet many.

        The rows are counted before they are used: with more than `lookup_rows` both stay as they are.
        """
        o = self.options
        shared = [v for v in found.names if v in more.names and v in found.definite and v in more.definite]
        if not o.lookup_rows or o.naive_join_order or self.schema is not None or not shared or found.expected > o.lookup_rows or more.expected < o.lookup_from:
            return found, more
        rows = found.df.limit(o.lookup_rows + 1).toArrow()
        if rows.num_rows > o.lookup_rows:
            return Bindings(found.df, found.names, found.definite, found.keys, float(rows.num_rows)), more
        df = F.broadcast(self.source.spark.createDataFrame(rows, found.df.schema)) if rows.num_rows else found.df.limit(0)
        here = Bindings(df, found.names, found.definite, found.keys, float(rows.num_rows))
        v = next((v for v in shared if triples[0].s == Var(v)), shared[0])
        if len(triples) == 1:
            more = replace(self.source.scan(triples[0], graph, by=v), expected=more.expected)
        if v in found.keys and v in more.keys and found.keys[v][0] == more.keys[v][0]:
            kept = F.col(more.keys[v][1]).isin(sorted({*rows.column(found.keys[v][1]).to_pylist()}))
        else:
            kept = more.col(v)["v"].isin(sorted({t["v"] for t in rows.column(found.names[v]).to_pylist()}))
        self.notes.append(f"looked up: {rows.num_rows} rows' ?{v} in {_patterns(triples)}")
        if self.options.row_counts:
            self.counted[-1].rows = rows.num_rows
        return here, more.filtered(kept)

    def ordered(self, parts: list[tuple[list[Triple], Bindings]], graph: Slot | None) -> list[tuple[list[Triple], Bindings]]:
        """Smallest first, then always the smallest that shares a variable with what is there; ties keep the written order."""
        if self.options.naive_join_order or len(parts) == 1:
            return parts
        parts = [(ts, replace(b, expected=min(self.source.cardinality(t, graph) for t in ts))) for ts, b in parts]
        size = {id(b): b.expected for _, b in parts}
        left, out = list(parts), []
        bound: set[str] = set()
        while left:
            linked = [p for p in left if bound & set(p[1].names)] or left
            best = min(linked, key=lambda p: size[id(p[1])])
            left.remove(best)
            out.append(best)
            bound |= set(best[1].names)
        self.notes.append("order: " + " | ".join(f"{' '.join(map(_slot, t.slots()))} (~{size[id(b)]:.0f})" for ts, b in out for t in ts))
        return out

    def entailed(self, t: Triple, graph: Slot | None) -> Bindings:
        """The pattern's bindings with what the RDFS rules add: a set, if more than one scan answers."""
        schema, scans = self.schema, []
        if not isinstance(t.p, T.Term):
            return self.source.scan(t, graph)
        if t.p.v == T.TYPE:
            if not isinstance(t.o, T.Term):
                return self.source.scan(t, graph)
            other = Var("_bnode_ other")
            scans = self.among(t, "o", schema.classes_entailing(t.o), graph)
            scans += self.among(Triple(t.s, t.p, other), "p", schema.properties_with_domain(t.o), graph)
            scans += self.among(Triple(other, t.p, t.s), "p", schema.properties_with_range(t.o), graph)
        else:
            scans = self.among(t, "p", schema.properties_entailing(t.p), graph)
        if len(scans) == 1:
            return scans[0]
        wanted = list(dict.fromkeys([*t.variables(), *([graph.name] if isinstance(graph, Var) else [])]))
        found = project(scans[0], wanted)
        for s in scans[1:]:
            found = B.union(found, project(s, wanted))
        self.notes.append(f"entailed: {len(scans)} scans for {' '.join(map(_slot, t.slots()))}")
        if not wanted:
            return Bindings(found.df.limit(1), {}, frozenset())
        return B.distinct(found).sure(*wanted)

    def among(self, t: Triple, slot: str, terms: list[T.Term], graph: Slot | None) -> list[Bindings]:
        """The pattern with each of the terms in a slot: a scan for each or, where they are many, one that meets them all."""
        if len(terms) <= FEW_SCANS:
            return [self.source.scan(replace(t, **{slot: x}), graph) for x in terms]
        asked = Var("_bnode_ asked")
        found = self.source.scan(replace(t, **{slot: asked}), graph)
        values = self.source.spark.createDataFrame([(x.row(),) for x in terms], f"asked {T.TERM}")
        values = F.broadcast(values) if len(terms) <= BROADCAST_TERMS else values
        return [replace(found, df=found.df.join(values, B.same_term(found.col(asked.name), F.col("asked")), "left_semi"))]

    # --- modifiers ---
    def sort_keys(self, node: OrderBy, child: Bindings) -> list[Column]:
        scope = child.scope()
        keys = [(T.sort_key(compile_expr(e, scope).term()), down) for e, down in node.keys]
        return [k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in keys]

    def distinct(self, node: Distinct, graph: Slot | None) -> Bindings:
        """First rows of equal projections keep their order, also where the sort keys aren't projected."""
        inner = node.child
        if not (isinstance(inner, Project) and isinstance(inner.child, OrderBy)):
            return B.distinct(self.compile(inner, graph))
        order = inner.child
        child = self.compile(order.child, graph)
        if all(isinstance(v, str) and v in inner.names for e, _ in order.keys for v in expr_variables(e)):
            found = B.distinct(project(child, inner.names))
            return Bindings(found.df.orderBy(*self.sort_keys(order, found)), found.names, found.definite)
        keys = self.sort_keys(order, child)
        kept = project(child, inner.names)
        columns = list(dict.fromkeys(kept.names.values()))
        sorts = [f"k{i}" for i in range(len(keys))]
        plain = [T.sort_key(compile_expr(e, child.scope()).term()).alias(s) for (e, _), s in zip(order.keys, sorts)]
        df = child.df.select(*[(child.col(v) if v in child.names else T.unbound()).alias(kept.names[v]) for v in kept.names], *plain)
        by = [F.col(s).desc_nulls_last() if down else F.col(s).asc_nulls_first() for s, (_, down) in zip(sorts, order.keys)]
        df = df.withColumn("first", F.row_number().over(Window.partitionBy(*columns).orderBy(*by))).where("first = 1").orderBy(*by)
        return Bindings(df.select(*columns), kept.names, kept.definite)

    # --- groups ---
    def group(self, node: Group, graph: Slot | None) -> Bindings:
        child = self.compile(node.child, graph)
        scope = child.scope()
        keys = [scope.get(k, T.unbound()).alias(f"g{i}") for i, k in enumerate(node.keys)]
        names = [f"g{i}" for i in range(len(keys))]
        if not node.aggregates:
            df = child.df.select(*keys).distinct()
            return B.fresh(df, {k: F.col(f"g{i}") for i, k in enumerate(node.keys)}, set(node.keys) & child.definite)
        prepared, outputs = [], []
        apart: dict[Expr, list[tuple[int, Aggregate, Value]]] = {}
        for i, a in enumerate(node.aggregates):
            value = None if a.argument is None else compile_expr(a.argument, scope)
            if a.distinct and a.func in ("SUM", "AVG") and value is not None:
                apart.setdefault(a.argument, []).append((i, a, value))
                continue
            columns, out = aggregate(a, value, f"a{i}")
            prepared += columns
            outputs.append(out.alias(f"o{i}"))
        df = child.df.select(*keys, *prepared).groupBy(*names).agg(*outputs) if outputs else None
        for j, same in enumerate(apart.values()):  # distinct terms first, then their numbers: once for all aggregates of one argument
            one = child.df.select(*keys, same[0][2].term().alias("t")).distinct()
            t = Value("term", F.col("t"))
            sums = [aggregate(replace(a, distinct=False), t, "t", ready=True)[1].alias(f"o{i}") for i, a, _ in same]
            if not outputs:
                df = one.groupBy(*names).agg(*sums)
                outputs = sums
                continue
            part = one.groupBy(*[F.col(n).alias(f"h{j}{n}") for n in names]).agg(*sums)
            on = F.lit(True)
            for n in names:
                on = on & F.col(n).eqNullSafe(F.col(f"h{j}{n}"))
            df = df.join(part, on) if names else df.crossJoin(part)
        columns = {k: F.col(f"g{i}") for i, k in enumerate(node.keys)} | {a.out: F.col(f"o{i}") for i, a in enumerate(node.aggregates)}
        sure = (set(node.keys) & child.definite) | {a.out for a in node.aggregates if a.func in ("COUNT", "SUM")}
        return B.fresh(df, columns, sure)


def aggregate(a: Aggregate, value: Value | None, name: str, ready: bool = False) -> tuple[list[Column], Column]:
    """What an aggregate needs of each row, and its result over those columns (over the value itself, if ready).

    Sums and counts take plain numbers and flags: no term is built for a row that is only added up.
    """
    true, double = F.lit(True), F.lit(False)
    if value is None:
        return [], T.number_term(F.count(F.lit(1)).cast("double"), true)
    parts = {"x": value.term(), "n": value.number(), "b": value.bound()}
    used = "nb" if a.func in ("SUM", "AVG") else "b" if a.func == "COUNT" and not a.distinct else "x"
    columns = [] if ready else [parts[p].alias(f"{name}{p}") for p in used]
    x, n, b = (parts[p] if ready else F.col(f"{name}{p}") for p in "xnb")
    match a.func:
        case "COUNT":
            found = T.number_term((F.count_distinct(x) if a.distinct else F.count_if(b)).cast("double"), true)
        case "SUM":
            total = F.coalesce(F.sum(n), F.lit(0.0))
            found = F.when(F.count_if(b) == 0, T.constant(T.literal("0", datatype=T.INTEGER))).otherwise(T.number_term(total, double))
        case "AVG":
            found = F.when(F.count_if(b) > 0, T.number_term(F.coalesce(F.sum(n), F.lit(0.0)) / F.count_if(b), double))
        case "MAX":
            found = F.max_by(x, T.sort_key(x))
        case _:  # MIN, and SAMPLE, for which any value will do
            found = F.min_by(x, T.sort_key(x))
    return columns, found


def project(child: Bindings, names) -> Bindings:
    names = list(dict.fromkeys(names))
    return B.fresh(child.df, {v: child.col(v) if v in child.names else T.unbound() for v in names}, {v for v in names if v in child.definite}, child.key(*names))


def observed(found: Bindings, place: Counted) -> Bindings:
    return replace(found, df=found.df.observe(place.metric, F.count(F.lit(1)).alias("rows")))


def _slot(x: Slot) -> str:
    return f"?{x.name}" if isinstance(x, Var) else str(x)


def _patterns(triples: list[Triple]) -> str:
    return " , ".join(" ".join(map(_slot, t.slots())) for t in triples)


def compile_query(query: Query, source: Source, options: Options = Options()) -> tuple[Bindings, Compiler]:
    compiler = Compiler(source, options)
    return compiler.compile(query.root), compiler
