"""Solution mappings as DataFrames: one term column for each variable in scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T

_numbers = count()
#: Pairs of rows, as the planner expects them, that a task of a join of many with many gets about; its tasks at most; rows of the smaller side that are broadcast for it at most, and tasks that each of more rows goes to at most.
TASK_PAIRS, MOST_TASKS, BROADCAST_ROWS, SHARES = 1 << 30, 1 << 13, 1 << 19, 64
#: Of a join that pairs all rows with all: rows of a side, and pairs, up to which they are left to Spark; pairs of a task while these make fewer than `SOME_TASKS`; pairs of a task otherwise; rows of a pack; rows of the other side that a task has, as far as there are tasks (Spark keeps so many as they are, and sorts more away).
FEW_ROWS, FEW_PAIRS, LEAST_PAIRS, SOME_TASKS, CELL_PAIRS, PACK_ROWS, SHARE_ROWS = 1 << 6, 1 << 22, 1 << 20, 64, 1 << 26, 1 << 7, 1 << 12
#: A plain column that says which of the terms of one kind (its domain) a variable is bound to.
Keys = dict[str, tuple[str, Column]]


def fresh(df: DataFrame, columns: dict[str, Column], definite: set[str], keys: Keys | None = None) -> Bindings:
    """df's columns under names of their own, so that joins never meet a name twice (SPARQL tells ?x from ?X, Spark doesn't)."""
    names = {v: f"v{next(_numbers)}" for v in columns}
    short = {v: (domain, f"k{next(_numbers)}") for v, (domain, _) in (keys or {}).items() if v in columns}
    df = df.select(*[c.alias(names[v]) for v, c in columns.items()], *[keys[v][1].alias(k) for v, (_, k) in short.items()])
    return Bindings(df, names, frozenset(definite), short)


@dataclass(frozen=True)
class Bindings:
    df: DataFrame
    names: dict[str, str]
    #: Variables that no row leaves unbound.
    definite: frozenset[str]
    #: Of some definite variables: a domain, and a column that is equal just where the terms are. Joins within a domain compare it instead.
    keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Rows that the planner expects.
    expected: float = float("inf")
    #: Variables whose terms many rows may have: a table's columns, not its subjects.
    many: frozenset[str] = frozenset()

    def col(self, var: str) -> Column:
        return F.col(self.names[var])

    def key(self, *names: str) -> Keys:
        return {v: (self.keys[v][0], F.col(self.keys[v][1])) for v in names if v in self.keys}

    def columns(self) -> list[str]:
        return [*self.names.values(), *(k for _, k in self.keys.values())]

    def scope(self) -> dict[str, Column]:
        return {v: self.col(v) for v in self.names}

    def filtered(self, condition: Column) -> Bindings:
        return replace(self, df=self.df.where(condition))

    def sure(self, *names: str) -> Bindings:
        return replace(self, definite=self.definite | set(names))


def same_term(x: Column, y: Column) -> Column:
    """Identity of terms, field by field: Spark can join on fields of a scan, filter the other side by them at run time and compare them without building a struct; a number follows from its text and datatype."""
    return (x["v"] == y["v"]) & (x["k"] == y["k"]) & (x["l"] == y["l"]) & (x["d"] == y["d"])


def compatible(a: Bindings, b: Bindings, shared: list[str]) -> Column | None:
    """Equality where both sides are always bound; else either side may be unbound."""
    found = None
    for v in shared:
        x, y = a.col(v), b.col(v)
        if v in a.keys and v in b.keys and a.keys[v][0] == b.keys[v][0]:
            one = F.col(a.keys[v][1]) == F.col(b.keys[v][1])
        else:
            one = same_term(x, y)
        if v not in a.definite:
            one = one | x.isNull()
        if v not in b.definite:
            one = one | y.isNull()
        found = one if found is None else found & one
    return found


def merged(a: Bindings, b: Bindings) -> dict[str, Column]:
    """The scope of a row joined of both."""
    out = a.scope()
    for v in b.names:
        if v not in out:
            out[v] = b.col(v)
        elif v not in a.definite:
            out[v] = F.coalesce(a.col(v), b.col(v))
    return out


def _where_bound(a: Bindings, v: str) -> Bindings:
    return a if v in a.definite else a.filtered(a.col(v).isNotNull()).sure(v)


def _where_unbound(a: Bindings, v: str) -> Bindings:
    """The rows that leave v unbound, without v."""
    kept = a.filtered(a.col(v).isNull())
    return Bindings(kept.df, {x: n for x, n in a.names.items() if x != v}, a.definite, {x: k for x, k in a.keys.items() if x != v})


def join(a: Bindings, b: Bindings, hint: str | None = None) -> Bindings:
    """Natural join over all shared variables.

    Where none of these is always bound on both sides, no equality would be left to join on. Then rows
    are split by one of them: those that bind it on both sides join on it, and only rows
    that leave it unbound meet all others, as they must.
    """
    shared = [v for v in a.names if v in b.names]
    if _unsure(a, b, shared):
        v = shared[0]
        found = join(_where_bound(a, v), _where_bound(b, v), hint)
        if v not in a.definite:
            found = union(found, join(_where_unbound(a, v), b, hint))
        if v not in b.definite:
            found = union(found, join(_where_bound(a, v), _where_unbound(b, v), hint))
        return found
    on = compatible(a, b, shared)
    expected = min(a.expected, b.expected) if shared else a.expected * b.expected
    right = b.df.hint(hint) if hint else b.df
    if on is not None and hint is None and all(v in a.many and v in b.many for v in shared):
        df = _dealt_join(a, b, on, [v for v in shared if v in a.definite and v in b.definite])
    else:
        df = _all_pairs(a, b) if on is None else a.df.join(right, on, "inner")
    scope = merged(a, b)
    if all(v in a.names and v in a.definite or v not in a.names for v in b.names):
        found = Bindings(df, {**b.names, **a.names}, a.definite | b.definite, {**b.keys, **a.keys})
        return replace(found, df=df.select(*found.columns()), expected=expected, many=a.many | b.many)
    return replace(fresh(df, scope, a.definite | b.definite, b.key(*(v for v in b.names if v not in a.names)) | a.key(*a.definite)), expected=expected, many=a.many | b.many)


def _dealt_join(a: Bindings, b: Bindings, on: Column, sure: list[str]) -> DataFrame:
    """The inner join of many rows with many for each term, in tasks that follow the pairs of rows: a few terms, or one file, don't make a few tasks.

    The larger side's rows are dealt out by their hash. Each of its shares meets all of the smaller side: by a
    broadcast where that has few rows, else by a shuffle in which each of its rows goes to every share.
    """
    pairs = a.expected * b.expected
    tasks = min(MOST_TASKS, -(-int(pairs) // TASK_PAIRS)) if pairs < float("inf") else 1
    if tasks <= 1:
        return a.df.join(b.df, on, "inner")
    small, large = (a, b) if a.expected < b.expected else (b, a)
    row = F.xxhash64(*large.columns())
    if small.expected <= BROADCAST_ROWS:
        return large.df.repartition(tasks, row).join(F.broadcast(small.df), on, "inner")
    shares = min(tasks, SHARES)
    v = sure[0]
    keyed = v in a.keys and v in b.keys and a.keys[v][0] == b.keys[v][0]
    term = lambda x: F.col(x.keys[v][1]) if keyed else x.col(v)["v"]
    name = f"share{next(_numbers)}"
    left = large.df.withColumn(f"{name}a", F.pmod(row, F.lit(shares)).cast("int")).repartition(tasks, term(large), F.col(f"{name}a"))
    right = small.df.withColumn(f"{name}b", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, term(small), F.col(f"{name}b"))
    return left.join(right, on & (F.col(f"{name}a") == F.col(f"{name}b")), "inner").drop(f"{name}a", f"{name}b")


def _all_pairs(a: Bindings, b: Bindings) -> DataFrame:
    """Every row of one side with every row of the other; many pairs in tasks that follow their number, and in an order that takes few bytes to write.

    One side's rows are packed in short arrays. A task gets some of the packs and a share of the other side's rows,
    and writes each row with a whole pack: few terms of each side are in one file, so its dictionaries hold them, and
    what follows repeats what was just written. Both sides are counted first, which is little beside pairing them.
    The packs and shares meet in a Cartesian product, which gives a pair at a time: a hash join's generated code
    would hold all rows that a pack makes with its whole share before it hands on the first.
    """
    plain = a.df.crossJoin(b.df)
    if not a.columns() or not b.columns() or a.expected * b.expected <= FEW_PAIRS or any(x.df.limit(FEW_ROWS + 1).count() <= FEW_ROWS for x in (b, a)):
        return plain
    packed, other = (a, b) if len(a.names) <= len(b.names) else (b, a)
    n, m = packed.df.count(), other.df.count()
    if n * m <= FEW_PAIRS:
        return plain
    tasks = min(MOST_TASKS, max(-(-n * m // CELL_PAIRS), min(SOME_TASKS, -(-n * m // LEAST_PAIRS))))
    groups = min(tasks, max(1, round(sqrt(tasks * n / m))))
    shares = max(-(-tasks // groups), min(tasks, -(-m // SHARE_ROWS)))
    groups = -(-tasks // shares)
    packs = max(groups, -(-n // PACK_ROWS))
    pack, rows, share = (f"{x}{next(_numbers)}" for x in ("pack", "rows", "share"))
    left = _lots(packed, packs, pack).groupBy(pack).agg(F.collect_list(F.struct(*packed.columns())).alias(rows))
    left = left.repartitionById(groups, F.col(pack) % groups).select(rows)
    right = _lots(other, shares, share).repartitionById(shares, F.col(share)).select(*other.columns())
    met = left.crossJoin(right.hint("shuffle_replicate_nl")).select(F.explode(rows).alias(rows), *other.columns())
    return met.select(*[F.col(f"{rows}.{c}").alias(c) for c in packed.columns()], *other.columns())


def _lots(a: Bindings, lots: int, name: str) -> DataFrame:
    """a's rows with a lot each, by their hash; equal ones are numbered first, so that many copies of a row don't fall to one."""
    copy = f"copy{next(_numbers)}"
    numbered = a.df.select(*a.columns()).withColumn(copy, F.row_number().over(Window.partitionBy(*a.columns()).orderBy(F.lit(0))))
    return numbered.select(*a.columns(), F.pmod(F.xxhash64(*a.columns(), copy), F.lit(lots)).cast("int").alias(name))


#: A condition over the scope of rows joined of both sides; none holds always.
Condition = Callable[[dict[str, Column]], Column | None]


def _unsure(a: Bindings, b: Bindings, shared: list[str]) -> bool:
    """Whether there are shared variables, but none that both sides always bind: no equality to join on."""
    return bool(shared) and not any(v in a.definite and v in b.definite for v in shared)


def left_join(a: Bindings, b: Bindings, condition: Condition) -> Bindings:
    shared = [v for v in a.names if v in b.names]
    if _unsure(a, b, shared):
        return _left_join_by_parts(a, b, condition)
    on, extra = compatible(a, b, shared), condition(merged(a, b))
    on = extra if on is None else on if extra is None else on & extra
    df = a.df.join(b.df, F.lit(True) if on is None else on, "left")
    return fresh(df, merged(a, b), set(a.definite), a.key(*a.definite))


def _left_join_by_parts(a: Bindings, b: Bindings, condition: Condition) -> Bindings:
    """The inner join, which splits rows by what they bind, and the rows of a that have no partner in it.

    Rows of a are told apart by their terms alone: equal rows have equal partners. So no row
    has to be numbered, and only rows that leave the variable unbound meet all others, as they must.
    """
    kept = {v: f"kept {v}" for v in a.names}
    own = a.df.select(*a.names.values(), *[a.col(v).alias(f"{a.names[v]}_kept") for v in a.names])
    inner = join(Bindings(own, a.names | {kept[v]: f"{a.names[v]}_kept" for v in a.names}, a.definite | {kept[v] for v in a.definite}), b)
    holds = condition(inner.scope())
    inner = inner if holds is None else inner.filtered(holds)
    met = fresh(inner.df, {v: inner.col(kept[v]) for v in a.names}, set(a.definite))
    on = F.lit(True)
    for v in a.names:
        on = on & (same_term(a.col(v), met.col(v)) if v in a.definite else a.col(v).eqNullSafe(met.col(v)))
    alone = Bindings(a.df.select(*a.names.values()).join(met.df.distinct(), on, "left_anti"), a.names, a.definite)
    found = fresh(inner.df, {v: inner.col(v) for v in inner.names if v not in kept.values()}, set(inner.definite) - set(kept.values()))
    return union(found, alone)


def anti_join(a: Bindings, b: Bindings, condition: Condition) -> Bindings:
    """Rows of a without a partner in b; b's own variables are unbound."""
    on, extra = compatible(a, b, [v for v in a.names if v in b.names]), condition(merged(a, b))
    on = extra if on is None else on if extra is None else on & extra
    return Bindings(a.df.join(b.df, F.lit(True) if on is None else on, "left_anti"), a.names, a.definite, a.keys)


def union(a: Bindings, b: Bindings) -> Bindings:
    """All rows of both; a variable of one side only is unbound on the other."""
    order = list(dict.fromkeys([*a.names, *b.names]))
    sides = [x.df.select(*[(x.col(v) if v in x.names else T.unbound()).alias(f"u{i}") for i, v in enumerate(order)]) for x in (a, b)]
    if not order:
        return Bindings(a.df.unionAll(b.df), {}, frozenset())
    return fresh(sides[0].unionAll(sides[1]), {v: F.col(f"u{i}") for i, v in enumerate(order)}, set(a.definite & b.definite))


def distinct(a: Bindings) -> Bindings:
    return Bindings(a.df.select(*a.names.values()).distinct(), a.names, a.definite)
