"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source gets the same real number of copies, target / source size; its
fraction is rounded to 0 or 1. Documents of a source meet in pairs: word mass moves from one
to the other, at random and without bias, until one of them is whole. A chunk of some 64
documents of one size class ends with one fractional document at most; these meet in chunks
again, level by level, until one chunk of each class is left. At the root of a source's tree
the last chunks of its classes meet: each document, the largest first, moves mass to or
from all that are smaller, in proportion, so that these make up for it. All moves keep a
source's mass and every document's expected copies; only the very last document of a source,
which nothing can make up for, goes to the nearer end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled

WEIGHTS = (5.0, 2.0, 1.0)
FAN_IN = 64
#: A catalogue of so many (source, size class) rows at most is broadcast to the documents; a larger one is joined by shuffle.
BROADCAST_STRATA = 100_000

_ITEM = "struct<did:bigint,th:bigint,rows:bigint,a:double,full:double>"
_FIELDS = ("did", "th", "rows", "a", "full")


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, take `weights` in turn and share `share` times
    all sizes; none gets more than `limit` times its own, and what is over goes to the
    others by weight. That ends at min(limit x size, level x weight) with one level for
    all, found from running sums over the sources sorted by limit x size / weight. One row
    per source is sorted in one task: the catalogue, not the documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1))
    by = by.withColumn("cap", limit * F.col("source_size")).withColumn("at", F.col("cap") / F.col("weight"))
    every = Window.orderBy("at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    by = by.withColumn("rank", F.row_number().over(every))
    capped = F.coalesce(F.sum("cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(every.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (share * F.sum("source_size").over(whole) - capped) / rest)
    by = by.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("at"), F.col("rank"))).over(whole))
    return by.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being made once."""
    return F.transform(F.array(value), use)[0]


def _with_mass(x: Column, mass: Column) -> Column:
    return F.struct(*[(mass if n == "a" else x[n]).alias(n) for n in _FIELDS]).cast(_ITEM)


def _draw(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def _met(x: Column, y: Column, seed: int) -> Column:
    """Two fractional documents after they met: one of them at least is whole, at exactly 0 or its full mass."""
    a, b, room_a, room_b = x["a"], y["a"], x["full"] - x["a"], y["full"] - y["a"]
    draw = _draw(x["did"], x["th"], y["did"], y["th"], F.lit(seed))

    def moved(w: Column) -> Column:
        rises = draw * (w["up"] + w["down"]) < w["down"]
        to_x = F.when(rises, F.when(room_a <= b, x["full"]).otherwise(a + b)).otherwise(F.when(a <= room_b, F.lit(0.0)).otherwise(a - room_b))
        to_y = F.when(rises, F.when(room_a <= b, b - room_a).otherwise(F.lit(0.0))).otherwise(F.when(a <= room_b, a + b).otherwise(y["full"]))
        return F.array(_with_mass(x, to_x), _with_mass(y, to_y))

    return _let(F.struct(F.least(room_a, b).alias("up"), F.least(a, room_b).alias("down")), moved)


def _is_whole(x: Column) -> Column:
    return (x["a"] <= 0) | (x["a"] >= x["full"])


def _rounded(items: DataFrame, seed: int) -> DataFrame:
    """Chunks of items to (source, class, chunks, chunk, cur, out): the document that stays fractional, if any, and those that are whole."""
    one = F.struct(F.xxhash64("did", "th", F.lit(seed)).alias("h"), *_FIELDS)
    lists = items.groupBy("source", "class", "chunks", "chunk").agg(F.array_sort(F.collect_list(one)).alias("items"))
    start = F.struct(F.lit(None).cast(_ITEM).alias("cur"), F.array().cast(f"array<{_ITEM}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        both = _let(_met(s["cur"], x, seed), lambda m: F.struct(F.get(F.filter(m, lambda d: ~_is_whole(d)), F.lit(0)).alias("cur"), F.concat(s["out"], F.filter(m, _is_whole)).alias("out")))
        return F.when(s["cur"].isNull(), F.struct(_with_mass(x, x["a"]).alias("cur"), s["out"].alias("out"))).otherwise(both)

    return lists.select("source", "class", "chunks", "chunk", F.aggregate("items", start, step).alias("f")).select("source", "class", "chunks", "chunk", "f.cur", "f.out")


def _settled_together(items: DataFrame, seed: int) -> DataFrame:
    """The last chunks of a source's classes (of some 64 documents, and 40 classes at most), made whole together, as (source, out).

    The largest document first, each becomes whole at the cost of the pool of all after it:
    full with the chance of its fraction, else empty. What the pool gives or gets, its
    documents share: their fractions f become p f + q, with one p and q for all. A document
    that the pool could make up for at one end alone goes there; if at neither, where less is lacking.
    """
    one = F.struct((-F.col("full")).alias("o"), F.xxhash64("did", "th", F.lit(seed)).alias("h"), *_FIELDS)
    lists = items.groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("items"))
    total = lambda of: F.aggregate("items", F.lit(0.0), lambda s, x: s + x[of])
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), total("a").alias("mass"), total("full").alias("full"), F.array().cast(f"array<{_ITEM}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full, rest_full, rest_mass = x["full"], s["full"] - x["full"], s["mass"] - x["a"]
        own = F.greatest(F.lit(0.0), F.least(full, s["p"] * x["a"] + s["q"] * full))
        pool = F.greatest(F.lit(0.0), F.least(rest_full, s["p"] * rest_mass + s["q"] * rest_full))

        def moved(w: Column) -> Column:
            room = rest_full - w["pool"]
            lack_up, lack_down = full - w["own"] - w["pool"], w["own"] - room
            rises = F.when((lack_up <= 0) & (lack_down <= 0), _draw(x["did"], x["th"], F.lit(seed + 1)) * full < w["own"]).otherwise(lack_up < lack_down)
            keeps = F.when(w["pool"] > 0, 1 - F.least(full - w["own"], w["pool"]) / w["pool"]).otherwise(1.0)
            rooms = F.when(room > 0, 1 - F.least(w["own"], room) / room).otherwise(1.0)
            return F.struct(
                F.when(rises, s["p"] * keeps).otherwise(s["p"] * rooms).alias("p"), F.when(rises, s["q"] * keeps).otherwise(s["q"] * rooms + 1 - rooms).alias("q"),
                rest_mass.alias("mass"), rest_full.alias("full"), F.concat(s["out"], F.array(_with_mass(x, F.when(rises, full).otherwise(0.0)))).alias("out"),
            )

        return _let(F.struct(own.alias("own"), pool.alias("pool")), moved)

    return lists.select("source", F.aggregate("items", start, step)["out"].alias("out"))


def mix(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, th, rows, source, size, source_size, target, copies).

    `size` counts the words of a text (null: 0), th is the text's xxhash64 (null: that of
    the empty text), `rows` how many equal rows (doc_id, source, text) there are and
    `copies` how many copies they get together: rows x target / source_size, rounded up or
    down. A document without words weighs nothing: its fraction is dropped. Null ids and
    null sources are values like any other; an empty table gives no row. Every random
    draw is a hash of the ids met, so reruns agree. A document is read once, and goes
    through the shuffle for its chunk once; what is decided is never joined back.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("did"), "source", F.xxhash64(text).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    base = base.groupBy("did", "source", "th", "size").agg(F.count(F.lit(1)).alias("rows"))
    base = settled(base.withColumn("class", F.coalesce(F.floor(F.log2("size")), F.lit(-1)).cast("int")))
    strata = settled(base.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count(F.lit(1)).alias("n")))
    targets = settled(source_targets(strata.select("source", "size"), share, limit, weights))
    known = targets.withColumnRenamed("source", "_s")
    chunks = F.ceil(F.col("n") / FAN_IN).cast("bigint")
    strata = strata.join(known, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.col("class").alias("_c"), chunks.alias("chunks"), "source_size", "target")
    small = (lambda df: F.broadcast(df)) if strata.count() <= BROADCAST_STRATA else (lambda df: df)
    per = F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.when(F.col("size") > 0, per - F.floor(per)).otherwise(F.lit(0.0))
    dealt = base.join(small(strata), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c"))).withColumn("part", part)
    whole = dealt.where("part <= 0").select("source", "did", "th", "rows", F.lit(0.0).alias("a"), F.col("size").cast("double").alias("full"))
    items = dealt.where("part > 0").select(
        "source", "class", "chunks", F.pmod(F.xxhash64("did", "th", F.lit(seed + 1)), "chunks").alias("chunk"),
        "did", "th", "rows", (F.col("part") * F.col("size")).alias("a"), F.col("size").cast("double").alias("full"),
    )
    most = strata.agg(F.coalesce(F.max("chunks"), F.lit(1))).first()[0]
    done, last, level = [], [], 0
    while most > 1:
        last.append(items.where("chunks <= 1"))
        rounded = settled(_rounded(items.where("chunks > 1"), seed + 2 + level))
        done.append(rounded.select("source", "out"))
        up = F.ceil(F.col("chunks") / FAN_IN).cast("bigint").alias("chunks")
        items = rounded.where("cur is not null").select("source", "class", up, F.floor(F.col("chunk") / FAN_IN).alias("chunk"), "cur.*")
        most, level = -(-most // FAN_IN), level + 1
    last.append(items)
    rest = last[0]
    for x in last[1:]:
        rest = rest.unionByName(x)
    done.append(_settled_together(rest, seed + 2 + level))
    out = whole
    for d in done:
        out = out.unionByName(d.select("source", F.explode("out").alias("d")).select("source", "d.*"))
    takes = F.when((F.col("a") >= F.col("full")) & (F.col("full") > 0), 1).otherwise(0)
    out = out.join(small(known), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("did").alias("doc_id"), "th", "rows", "source", F.col("full").cast("bigint").alias("size"), "source_size", "target", (F.floor(per) + takes).cast("bigint").alias("copies"))


def per_row(mixed: DataFrame) -> DataFrame:
    """A row for each row of the documents: equal rows share their copies as evenly as can be."""
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))
    own = (F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("bigint")).cast("bigint")
    return mixed.withColumn("nth", nth).withColumn("copies", own)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    shares = per_row(mix(docs.select("doc_id", "text", "source"), **options))
    shares = shares.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("th").alias("_t"), F.col("nth").alias("_n"), F.col("copies").alias("_c")).where("_c > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.col("source").alias("_source"), F.col("doc_id").cast("bigint").alias("_id"))
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_th").orderBy("_th")) - 1
    keyed = keyed.withColumn("_nth", nth)
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_th") == F.col("_t")) & (F.col("_nth") == F.col("_n"))
    taken = keyed.join(shares, same)
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
