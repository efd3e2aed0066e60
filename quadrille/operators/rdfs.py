"""RDFS entailment: rules 2, 3, 5, 7, 9 and 11.

The schema (subclasses, subproperties, domains, ranges) is closed on the driver where its statements
and the closed rules are few, both counted; else on executors, where walks of twice the
length are joined in each round. In a round the data meet the closed rules in one join
(broadcast up to a size) and one shuffle removes what is already known.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Term

SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = (T.RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))
VOCABULARY = [SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE]
#: Schema statements that the driver may hold at most.
MAX_SCHEMA = 1_000_000
#: Pairs of closed rules that the driver may hold at most.
MAX_PAIRS = 1_000_000

Relation = dict[Term, set[Term]]


class TooLarge(ValueError):
    """A schema beyond what the driver may hold."""


def reachable(relation: Relation, start: Term) -> set[Term]:
    """Everything reachable; on a cycle that includes the start."""
    seen: set[Term] = set()
    todo = list(relation.get(start, ()))
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += relation.get(x, ())
    return seen


def inverse(relation: Relation) -> Relation:
    out: Relation = defaultdict(set)
    for a, above in relation.items():
        for b in above:
            out[b].add(a)
    return out


def within(relation: Relation, room: int = MAX_PAIRS) -> Relation:
    """The relation's closure, an error with more than so many pairs."""
    out: Relation = {}
    for start in relation:
        out[start] = reachable(relation, start)
        room -= len(out[start])
        if room < 0:
            raise TooLarge("more pairs of closed rules than the driver may hold")
    return out


@dataclass
class RdfsSchema:
    """A schema of few statements. As collected it isn't closed: questions follow the statements, in memory of their number."""

    sub_class: Relation
    sub_property: Relation
    domain: Relation
    range: Relation

    @classmethod
    def collect(cls, quads: DataFrame) -> RdfsSchema:
        """From the default graph of quads (g, s, p, o)."""
        rows = _statements(quads).limit(MAX_SCHEMA + 1).collect()
        if len(rows) > MAX_SCHEMA:
            raise TooLarge(f"more than {MAX_SCHEMA} schema statements")
        found: dict[str, Relation] = defaultdict(lambda: defaultdict(set))
        for r in rows:
            s, o = (Term(x.k, x.v, x.l, x.d) for x in (r.s, r.o))
            found[r.p.v][s].add(o)
        return cls(*(dict(found[v]) for v in VOCABULARY))

    def closed(self) -> RdfsSchema:
        """With subclasses and subproperties closed, TooLarge beyond MAX_PAIRS of each and of the rules."""
        found = RdfsSchema(within(self.sub_class), within(self.sub_property), self.domain, self.range)
        found.rules()
        return found

    @cached_property
    def below(self) -> tuple[Relation, Relation]:
        """Subproperties and subclasses, from above."""
        return inverse(self.sub_property), inverse(self.sub_class)

    def properties_entailing(self, p: Term) -> list[Term]:
        return [p, *sorted(reachable(self.below[0], p) - {p})]

    def classes_entailing(self, c: Term) -> list[Term]:
        return [c, *sorted(reachable(self.below[1], c) - {c})]

    def _with(self, relation: Relation, c: Term) -> list[Term]:
        classes = set(self.classes_entailing(c))
        direct = {p for p, of in relation.items() if of & classes}
        return sorted(direct | {x for p in direct for x in self.properties_entailing(p)})

    def properties_with_domain(self, c: Term) -> list[Term]:
        return self._with(self.domain, c)

    def properties_with_range(self, c: Term) -> list[Term]:
        return self._with(self.range, c)

    # --- closed rules for a pass over the data ---
    def above(self, p: Term) -> set[Term]:
        return self.sub_property.get(p, set()) | {p}

    def types(self, relation: Relation, p: Term) -> set[Term]:
        direct = {c for q in self.above(p) for c in relation.get(q, ())}
        return direct | {d for c in direct for d in self.sub_class.get(c, ())}

    def rules(self) -> tuple[Relation, Relation, Relation]:
        """Of each property of a closed schema: further properties, classes of the subject, classes of the object."""
        more = {p: above - {p} for p, above in self.sub_property.items()}
        of: tuple[Relation, Relation] = {}, {}
        room = MAX_PAIRS
        for p in {*self.sub_property, *self.domain, *self.range}:
            for found, relation in zip(of, (self.domain, self.range)):
                found[p] = self.types(relation, p)
                room -= len(found[p])
            if room < 0:
                raise TooLarge("more pairs of closed rules than the driver may hold")
        return more, *of

    # --- what a round asks of a closed schema ---
    def proposals(self, triples: DataFrame, stated: bool = False) -> DataFrame:
        """What the rules give over triples and, unless that was stated before, the closed schema itself."""
        return proposals(triples, self, stated)

    def changed_by(self, new: DataFrame, triples: DataFrame, settle) -> Schema | None:
        """The closed schema of triples, new ones among them, if it isn't this one."""
        if not _speaks_of_schema(new):
            return None
        found = closed_schema(_default(triples), settle)
        return None if found == self else found


class WideSchema:
    """A schema whose closure the driver can't hold: statements, closed pairs and rules are DataFrames.

    statements (s, p, o) need not be closed. Of what the rounds add only statements that don't
    follow from the others make a new schema, so that closed pairs are never closed again.
    """

    def __init__(self, statements: DataFrame, settle) -> None:
        self.statements = settle(statements.select("s", "p", "o").distinct())
        classes, properties = (transitive(self._of(v), settle) for v in (SUB_CLASS, SUB_PROPERTY))

        def types(name: str) -> DataFrame:
            direct = self._of(name)
            direct = direct.union(properties.join(direct.toDF("b", "c"), "b").select("a", F.col("c").alias("b")))
            return settle(direct.union(direct.join(classes.toDF("b", "c"), "b").select("a", F.col("c").alias("b"))).distinct())

        def rows(pairs: DataFrame, mode: int, of_class: bool = False) -> DataFrame:
            return pairs.select(F.lit(of_class).alias("ofclass"), F.col("a").alias("k"), F.lit(mode).cast("tinyint").alias("m"), F.col("b").alias("t"))

        self.rules = rows(properties.where("a <> b"), _MORE).union(rows(types(DOMAIN), _SUBJECT)).union(rows(types(RANGE), _OBJECT)).union(rows(classes, _SUBJECT, True))
        self.pairs = [x.select(F.col("a").alias("s"), T.constant(T.iri(v)).cast(T.TERM).alias("p"), F.col("b").alias("o")) for x, v in ((classes, SUB_CLASS), (properties, SUB_PROPERTY))]

    def _of(self, name: str) -> DataFrame:
        return self.statements.where(F.col("p.v") == name).select(F.col("s").alias("a"), F.col("o").alias("b"))

    def proposals(self, triples: DataFrame, stated: bool = False) -> DataFrame:
        """As for a schema on the driver, but both sides are shuffled; a type's rules hang on its class and on rdf:type."""
        of_predicate = F.struct(F.lit(False).alias("ofclass"), F.col("p").alias("k"))
        of_class = F.struct(F.lit(True).alias("ofclass"), F.col("o").alias("k"))
        keys = F.when(F.col("p.v") == T.TYPE, F.array(of_predicate, of_class)).otherwise(F.array(of_predicate))
        keyed = triples.select("s", "p", "o", F.inline(keys))
        found = _applied(keyed.join(self.rules, ["ofclass", "k"]), F.col("m"), F.col("t"))
        for x in [] if stated else self.pairs:
            found = found.unionAll(x)
        return found

    def changed_by(self, new: DataFrame, triples: DataFrame, settle) -> Schema | None:
        if not _speaks_of_schema(new):
            return None
        said = new.where(F.col("p.v").isin(VOCABULARY)).select("s", "p", "o")
        for x in self.pairs:
            said = said.join(x, ["s", "p", "o"], "left_anti")
        said = settle(said)
        return WideSchema(self.statements.unionByName(said), settle) if said.limit(1).count() else None


Schema = RdfsSchema | WideSchema


def closed_schema(quads: DataFrame, settle) -> Schema:
    """The closed schema of quads' default graph, on the driver where it is small."""
    try:
        return RdfsSchema.collect(quads).closed()
    except TooLarge:
        return WideSchema(_statements(quads), settle)


def transitive(edges: DataFrame, settle) -> DataFrame:
    """(a, b) of terms to all pairs that a walk along edges leads to.

    A round knows the pairs of walks of less than n edges and those of just n, and makes those of less than
    2n and of just 2n: so rounds are the logarithm of the longest of shortest walks, and in a chain or
    a tree each pair is found once. Where walks of n to 2n - 1 edges lead to no new pair none of
    n edges is shortest, so no longer one is: the end. Terms are numbered meanwhile.
    """
    terms = settle(edges.select("a").union(edges.select("b")).distinct().toDF("t").withColumn("id", F.monotonically_increasing_id()))
    a, b = terms.toDF("a", "x"), terms.toDF("b", "y")
    just = settle(edges.join(a, "a").join(b, "b").select("x", "y").distinct())
    found = just.limit(0)
    while True:
        walks = just.union(_walked(found, just)).distinct()
        new = settle(walks.join(found, ["x", "y"], "left_anti"))
        if not new.limit(1).count():
            return settle(found.join(a, "x").join(b, "y").select("a", "b"))
        found = found.union(new)
        just = settle(_walked(just, just).distinct())


def _walked(first: DataFrame, then: DataFrame) -> DataFrame:
    return first.toDF("x", "z").join(then.toDF("z", "y"), "z").select("x", "y")


def _statements(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("g").isNull() & F.col("p.v").isin(VOCABULARY)).select("s", "p", "o")


def _speaks_of_schema(triples: DataFrame) -> bool:
    return triples.where(F.col("p.v").isin(VOCABULARY)).limit(1).count() > 0


@dataclass(frozen=True)
class RdfsStats:
    before: int
    after: int
    inferred: int
    rounds: int


#: What a rule makes of a triple (s, p, o): the same with another predicate, a type of s, a type of o.
_MORE, _SUBJECT, _OBJECT = 0, 1, 2
#: Closed rules that are broadcast at most; more are joined by shuffle.
BROADCAST_RULES = 200_000


def proposals(triples: DataFrame, schema: RdfsSchema, stated: bool = False) -> DataFrame:
    """(s, p, o) that the rules give over triples (s, p, o), with repeats: one join with the closed rules, one explode.

    A triple's rules hang on its class where it is a type, else on its predicate. What the
    schema says of rdf:type itself holds for each type and stands in the plan as constants.
    """
    spark = triples.sparkSession
    more, of_subject, of_object = schema.rules()
    by_predicate: dict[Term, list[tuple[int, Term]]] = defaultdict(list)
    for mode, relation in ((_MORE, more), (_SUBJECT, of_subject), (_OBJECT, of_object)):
        for p, terms in relation.items():
            by_predicate[p] += [(mode, t) for t in sorted(terms)]
    own = by_predicate.pop(T.iri(T.TYPE), [])
    rows = [(False, p.row(), [(m, t.row()) for m, t in found]) for p, found in by_predicate.items() if found]
    rows += [(True, c.row(), [(_SUBJECT, t.row()) for t in sorted(above)]) for c, above in schema.sub_class.items() if above]
    is_type = F.col("p.v") == T.TYPE
    out = f"array<struct<m:tinyint,t:{T.TERM}>>"
    found = triples.limit(0)
    if rows or own:
        rules = spark.createDataFrame(rows, f"ofclass boolean, k {T.TERM}, outs {out}")
        if len(rows) <= BROADCAST_RULES:
            rules = F.broadcast(rules)
        keyed = triples.withColumn("ofclass", is_type).withColumn("k", F.when(is_type, F.col("o")).otherwise(F.col("p")))
        joined = keyed.join(rules, ["ofclass", "k"], "left" if own else "inner")
        always = F.array(*[F.struct(F.lit(m).cast("tinyint").alias("m"), T.constant(t).alias("t")) for m, t in own]).cast(out) if own else F.array().cast(out)
        outs = F.concat(F.coalesce("outs", F.array().cast(out)), F.when(is_type, always).otherwise(F.array().cast(out))) if own else F.col("outs")
        found = _applied(joined.select("s", "p", "o", F.explode(outs).alias("x")), F.col("x.m"), F.col("x.t"))
    closed = [] if stated else [(a.row(), T.iri(name).row(), b.row()) for name, relation in ((SUB_CLASS, schema.sub_class), (SUB_PROPERTY, schema.sub_property)) for a in sorted(relation) for b in sorted(relation[a])]
    return found.unionAll(spark.createDataFrame(closed, f"s {T.TERM}, p {T.TERM}, o {T.TERM}")) if closed else found


def _applied(triples: DataFrame, m: Column, t: Column) -> DataFrame:
    """What rules (m, t) make of triples beside them."""
    return triples.select(
        F.when(m == _OBJECT, F.col("o")).otherwise(F.col("s")).alias("s"),
        F.when(m == _MORE, t).otherwise(T.constant(T.iri(T.TYPE))).alias("p"),
        F.when(m == _MORE, F.col("o")).otherwise(t).alias("o"),
    )


#: Predicates of new triples up to which only those of the known ones are read.
FEW_PREDICATES = 64


def inferences(quads: DataFrame, settle, fresh: DataFrame | None = None, few=None) -> tuple[DataFrame, int, int]:
    """What follows from quads in the default graph and isn't there, as triples (s, p, o); how many; rounds.

    settle writes a DataFrame to storage and reads it back. One round is enough for a schema that does not speak of the RDFS
    vocabulary itself; the last round finds nothing. A round looks at what the round before added, and at
    everything only where that changed the schema. It goes on to the fixpoint: terms and so triples are finitely many.

    fresh: those of the quads that were added to others which are closed already; unless they
    change the schema, the first round looks at them alone. few: of a list of predicates, the
    quads that have them; then the known triples are read for the predicates of new ones only.
    """
    known = quads.where("g is null").select("s", "p", "o")
    schema, part, rounds, total = closed_schema(few(VOCABULARY) if few else quads, settle), known, 0, 0
    added = known.limit(0)
    if fresh is not None and not _speaks_of_schema(fresh.where("g is null")):
        part = fresh.where("g is null").select("s", "p", "o")
    stated = False
    while True:
        rounds += 1
        proposed, stated = schema.proposals(part, stated).distinct(), True
        held = known
        if few is not None:
            proposed = settle(proposed)
            names = [r[0] for r in proposed.select("p.v").distinct().limit(FEW_PREDICATES + 1).collect()]
            if len(names) <= FEW_PREDICATES:
                held = few(names).where("g is null").select("s", "p", "o")
        new = settle(proposed.join(held.unionByName(added), ["s", "p", "o"], "left_anti"))
        n = new.count()
        if not n:
            return added, total, rounds
        total, added, part = total + n, added.unionByName(new), new
        changed = schema.changed_by(new, known.unionByName(added), settle)
        if changed is not None:
            schema, part, stated = changed, known.unionByName(added), False


def _default(triples: DataFrame) -> DataFrame:
    return triples.select(F.lit(None).cast(T.TERM).alias("g"), "s", "p", "o")


def materialise(quads: DataFrame, settle, stored: bool = False) -> tuple[DataFrame, RdfsStats]:
    """quads with what follows in the default graph, to the fixpoint, and counts. They are settled too, as every round reads them, unless they are stored already."""
    data = quads if stored else settle(quads)
    before = data.where("g is null").count()
    added, n, rounds = inferences(data, settle)
    return data.unionByName(_default(added)), RdfsStats(before, before + n, n, rounds)
