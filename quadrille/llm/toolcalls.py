"""Linking tool calls to their results, in DataFrame functions only.

Calls and results meet in a hash join on (conversation, identifier), after equal identifiers
were counted and reduced to their first occurrence. Messages are ordered topologically: a
result after its call, a call after the results it depends on. Arguments are parsed,
validated against the tool's schema and written as canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Rows of a task in the rounds that order calls.
ROWS = 50_000
#: Calls of a stretch of turns in which cycles are looked for by the closure at once.
STRETCH = 64
#: JSON types of a schema and what the parser calls them.
TYPES = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT", "array": r"^ARRAY", "null": r"^VOID$"}


def json_text(s: Column) -> Column:
    """A string as a JSON string; null as null."""
    boxed = F.to_json(F.struct(s.alias("a")))
    return F.when(s.isNull(), "null").otherwise(F.substring(boxed, F.lit(6), F.length(boxed) - 6))


def problems(name: Column, parsed: Column, schemas: Mapping[str, Mapping]) -> Column:
    """What is wrong with parsed arguments (a variant), as an array of texts; the schemas are part of the plan.

    A schema: {"type": name or names, "enum": [...], "properties": {key: schema}, "required": [...],
    "additionalProperties": bool, "items": schema}, nested to any depth. A value of a wrong type is not
    looked into. Texts begin with the value's path: "a.b: missing", "a.c[2]: not string".
    """
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        out = F.when(name == tool, F.filter(_wrong(parsed, schema, F.lit("")), lambda x: x.isNotNull())).otherwise(out)
    return F.when(parsed.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(out)


def _wrong(value: Column, schema: Mapping, path: Column) -> Column:
    """An array of texts, null where nothing is wrong; a missing value (null) is right."""
    kind, at = F.schema_of_variant(value), F.regexp_replace(path, r"\.$", "")
    own: list[Column] = []
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    if types:
        own.append(F.when(~kind.rlike("|".join(TYPES[t] for t in types)), F.concat(at, F.lit(": not " + " or ".join(types)))))
    if "enum" in schema:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]
        own.append(F.when(~F.to_json(value).isin(allowed), F.concat(at, F.lit(": not allowed"))))
    out = [F.array(*own, F.lit(None).cast("string"))]
    for key, rule in schema.get("properties", {}).items():
        out.append(_wrong(F.try_variant_get(value, f'$["{key}"]', "variant"), rule, F.concat(path, F.lit(f"{key}."))))
    if schema.get("required") or not schema.get("additionalProperties", True):
        keys = F.when(kind.startswith("OBJECT"), F.json_object_keys(F.to_json(value)))
        missing = [F.when(~F.array_contains(keys, key), F.concat(path, F.lit(f"{key}: missing"))) for key in schema.get("required", [])]
        if not schema.get("additionalProperties", True):
            more = F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
            missing.append(F.when(F.size(more) > 0, F.concat(path, F.array_join(F.array_sort(more), "+"), F.lit(": unknown"))))
        out.append(F.array(*missing))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _wrong(x, schema["items"], F.concat(F.regexp_replace(path, r"\.$", ""), F.lit("["), i.cast("string"), F.lit("]."))))
        out.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.concat(*out))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments, depends_on) and results (conv_id, call_id, turn, content) to linked calls.

    One row for each (conv_id, call_id): name, call_turn, result_turn, n_calls, n_results,
    status (linked, unanswered: no result; orphan: no call), valid, errors, json, and the
    order within the conversation: (order_turn, order_level) of the call, the result directly
    after it at (result_order_turn, result_order_level). Where turns agree with the links they
    are the order; a message that comes before something it needs moves behind it. Of equal
    identifiers the lowest turn counts, then the least name and arguments; n_calls and
    n_results tell how many there were. Rows without conv_id or call_id can't be linked: each
    gets a row of status unidentified. Identifiers in depends_on that have no result are
    ignored, and so is what a call on a cycle needs (it stays at its turn, cyclic is true).
    Null turns come last. Empty tables give what the other table has.
    """
    late = F.lit((1 << 62)).cast("bigint")
    c = calls.select("conv_id", "call_id", F.coalesce(F.col("turn").cast("bigint"), late).alias("turn"), "name", "arguments", "depends_on")
    r = results.select("conv_id", "call_id", F.coalesce(F.col("turn").cast("bigint"), late).alias("turn"), "content")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    key = ["conv_id", "call_id"]
    first = c.where(known).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    answer = r.where(known).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = settled(first.join(answer, key, "full"))
    order = _ordered(both)
    rows = both.join(order, key, "left").select(
        *key, F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"), F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        "order_turn", "order_level", "result_order_turn", "result_order_level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    alone = c.where(~known).select(*key, "name", "arguments", F.lit(None).cast("string").alias("content"), F.col("turn").alias("call_turn"), F.lit(None).cast("bigint").alias("result_turn"), F.lit(1).cast("bigint").alias("n_calls"), F.lit(0).cast("bigint").alias("n_results"), *_loose("turn", True))
    lone = r.where(~known).select(*key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content", F.lit(None).cast("bigint").alias("call_turn"), F.col("turn").alias("result_turn"), F.lit(0).cast("bigint").alias("n_calls"), F.lit(1).cast("bigint").alias("n_results"), *_loose("turn", False))
    rows = rows.unionByName(alone).unionByName(lone)
    parsed = rows.withColumn("parsed", F.try_parse_json("arguments"))
    checked = parsed.withColumn("errors", F.when(F.col("n_calls") == 0, F.array().cast("array<string>")).otherwise(problems(F.col("name"), F.col("parsed"), schemas)))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), json_text(F.col("arguments"))), F.lit(',"id":'), json_text(F.col("call_id")),
        F.lit(',"name":'), json_text(F.col("name")), F.lit(',"result":'), json_text(F.col("content")), F.lit("}"),
    )
    turn = lambda x: F.when(F.col(x) < late, F.col(x)).alias(x)
    return checked.select(
        *key, "name", turn("call_turn"), turn("result_turn"), "n_calls", "n_results", "status", turn("order_turn"), "order_level", turn("result_order_turn"), "result_order_level", "cyclic",
        ((F.col("n_calls") > 0) & (F.size("errors") == 0)).alias("valid"), "errors", body.alias("json"),
    )


def _loose(turn: str, call: bool) -> Sequence[Column]:
    own, none = F.col(turn), F.lit(None).cast("bigint")
    first = (own, F.lit(0).cast("bigint"))
    pairs = (*first, none, none) if call else (none, none, *first)
    names = ("order_turn", "order_level", "result_order_turn", "result_order_level")
    return [F.lit("unidentified").alias("status"), *(p.alias(n) for p, n in zip(pairs, names)), F.lit(False).alias("cyclic")]


def _place(turn: Column, level: Column) -> Column:
    return F.struct(turn.alias("t"), level.cast("bigint").alias("l"))


def _ordered(both: DataFrame) -> DataFrame:
    """Places (turn, level) of calls and results: the least that respect all links.

    A call at p whose result has the turn r lets a call that needs it stand at the larger of
    (r, 1) and p two levels on. Calls that reach themselves stand on a cycle and need
    nothing. Only conversations in which something is misplaced take part.
    """
    key = ["conv_id", "call_id"]
    zero = F.lit(0).cast("bigint")
    needs = both.where("c is not null").select("conv_id", F.col("call_id").alias("later"), F.explode(F.array_distinct(F.filter("c.depends_on", lambda x: x.isNotNull()))).alias("call_id"))
    needs = settled(needs.join(both.where("r is not null").select(*key, F.when(F.col("c").isNotNull(), _place(F.col("c.turn"), zero)).alias("from"), F.col("r.turn").alias("turn")), key))
    places = both.select(*key, F.when(F.col("c").isNotNull(), _place(F.col("c.turn"), zero)).alias("p"), F.col("r.turn").alias("turn"), F.lit(False).alias("cyclic"))
    steps = needs.select("conv_id", F.col("call_id").alias("a"), F.col("later").alias("b"), _place(F.col("turn"), F.lit(1)).alias("c"), F.lit(2).cast("bigint").alias("k"), "from")
    bound = F.when(F.col("from").isNull(), F.col("c")).otherwise(F.greatest("c", _on(F.col("from"), F.col("k"))))
    own = places.where("p is not null").select("conv_id", F.col("call_id").alias("b"), "p")
    late = settled(steps.join(own, ["conv_id", "b"]).where(bound > F.col("p")).select("conv_id").distinct())
    if not late.isEmpty():
        steps = settled(steps.join(late, "conv_id", "left_semi"))
        turns = places.where("p is not null").join(late, "conv_id", "left_semi").select("conv_id", F.col("call_id").alias("b"), F.col("p.t").alias("turn"))
        on_cycle = _on_cycles(steps.where("from is not null").select("conv_id", "a", "b"), turns)
        steps = settled(steps.join(on_cycle, ["conv_id", "b"], "left_anti"))
        # results without a call have a place that nothing changes
        fixed = steps.where("from is null").groupBy("conv_id", "b").agg(F.max("c").alias("c"))
        nodes = places.where("p is not null").join(late, "conv_id", "left_semi").select("conv_id", F.col("call_id").alias("b"), "p").join(fixed, ["conv_id", "b"], "left")
        least = _least(nodes.select("conv_id", "b", F.greatest("p", "c").alias("p")), steps.where("from is not null").drop("from"))
        least = least.select("conv_id", F.col("b").alias("call_id"), F.col("p").alias("least"))
        loops = on_cycle.select("conv_id", F.col("b").alias("call_id"), F.lit(True).alias("loop"))
        moved = places.join(least, key, "left").join(loops, key, "left")
        places = moved.select(*key, F.coalesce("least", "p").alias("p"), "turn", F.coalesce("loop", F.lit(False)).alias("cyclic"))
    after = F.when(F.col("turn") > F.col("p.t"), _place(F.col("turn"), zero)).otherwise(_on(F.col("p"), F.lit(1)))
    out = places.withColumn("q", F.when(F.col("turn").isNotNull(), F.when(F.col("p").isNull(), _place(F.col("turn"), zero)).otherwise(after)))
    return out.select(*key, F.col("p.t").alias("order_turn"), F.col("p.l").alias("order_level"), F.col("q.t").alias("result_order_turn"), F.col("q.l").alias("result_order_level"), "cyclic")


def _on(place: Column, levels: Column) -> Column:
    return _place(place["t"], place["l"] + levels)


def _least(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The least places (conv_id, b, p) from those of nodes (conv_id, b, p) on that all steps (conv_id, a, b, c, k) allow: b at the larger of c and a's place k levels on.

    Along a path such bounds stay of that form. So each node keeps one more step, a shortcut: the path
    behind its tightest step, which is joined from round to round with the shortcut of
    the node that it comes from. A chain of n takes some log2(n) rounds, and a round's work
    follows the steps. It ends when no step is missed, which is exact whatever the shortcuts are.
    With nodes `most` given, a place beyond that level stays there: on and behind a cycle all get there.
    There paths also come in from nodes that stay where they are, and don't grow by going round; so then a
    shortcut is left out if its node hasn't risen in the later half of the rounds so far.
    """
    endless = "most" in nodes.columns
    most = F.col("most") if endless else F.lit(None).cast("bigint")
    none, kept, bound = F.lit(None), [c for c in nodes.columns if c != "p"], F.lit(1 << 40)
    kind = dict(steps.dtypes)
    # nodes and steps stay as many from round to round: few tasks for few of them, so that a round writes few files
    tasks = max(1, nodes.count() // ROWS)
    steps = settled(steps.coalesce(max(1, steps.count() // ROWS)))
    state = settled(nodes.coalesce(tasks).withColumn("s", none.cast(kind["a"])).withColumn("sc", none.cast(kind["c"])).withColumn("sk", none.cast("bigint")).withColumn("last", F.lit(0)))
    number = 0
    while True:
        number += 1
        if endless:
            risen = state.where(F.col("last") * 2 >= number).select("conv_id", F.col("b").alias("s"), F.lit(True).alias("live"))
            state = state.join(risen, ["conv_id", "s"], "left")
            state = state.select("conv_id", *[c for c in kept if c != "conv_id"], "p", "last", *[F.when(F.col("live"), F.col(c)).alias(c) for c in ("s", "sc", "sk")])
        shortcuts = state.where("s is not null").select("conv_id", F.col("s").alias("a"), "b", F.col("sc").alias("c"), F.col("sk").alias("k"), F.lit(False).alias("own"))
        origin = state.select("conv_id", F.col("b").alias("a"), "p", "s", "sc", "sk")
        offers = steps.select("conv_id", "a", "b", "c", "k", F.lit(True).alias("own")).unionByName(shortcuts).join(origin, ["conv_id", "a"])
        offer = F.greatest("c", _on(F.col("p"), F.col("k"))).alias("o")
        far = F.col("s").isNotNull()
        beyond = _place(F.col("sc.t"), F.least(F.col("sc.l") + F.col("k"), bound))
        longer = [F.coalesce("s", "a").alias("s"), F.when(far, F.greatest("c", beyond)).otherwise(F.col("c")).alias("sc"), F.when(far, F.least(F.col("sk") + F.col("k"), bound)).otherwise(F.col("k")).alias("sk")]
        best = offers.select("conv_id", "b", "own", offer, *longer).groupBy("conv_id", "b").agg(F.max(F.when(F.col("own"), F.col("o"))).alias("direct"), F.max(F.struct("o", "sk", "sc", "s")).alias("m"))
        held = F.coalesce(F.col("p.l") >= most, F.lit(False))
        higher = F.when(held | F.col("m").isNull(), F.col("p")).otherwise(F.greatest("p", "m.o"))
        higher = F.when(higher["l"] > most, _place(higher["t"], most)).otherwise(higher)
        missed = F.coalesce(~held & (F.col("direct") > F.col("p")), F.lit(False))
        both = state.select(*kept, "p", "last").join(best, ["conv_id", "b"], "left")
        state = settled(both.coalesce(tasks).select(*kept, higher.alias("p"), F.col("m.s").alias("s"), F.col("m.sc").alias("sc"), F.col("m.sk").alias("sk"), missed.alias("missed"), F.when(higher > F.col("p"), number).otherwise(F.col("last")).alias("last")))
        if state.where("missed").isEmpty():
            return state.select("conv_id", "b", "p")


def _on_cycles(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (conv_id, b) that steps (conv_id, a, b) lead back to; nodes: (conv_id, b, turn) of all calls.

    A cycle leads back in turns as far as it leads on. So it lies within a stretch of turns that is
    covered by steps from a later turn to an earlier one (or the same), and only steps within one stretch take
    part. In a long stretch those on and behind a cycle, and with all steps turned round those before one, are found
    first: there paths have no end. The closure is taken of what is left.
    """
    turn = lambda end: nodes.select("conv_id", F.col("b").alias(end), F.col("turn").alias(f"turn_{end}"))
    steps = steps.distinct().join(turn("a"), ["conv_id", "a"]).join(turn("b"), ["conv_id", "b"])
    back = steps.where("turn_a >= turn_b").select("conv_id", F.col("turn_b").alias("at"), F.col("turn_a").alias("to"), F.lit(None).cast(dict(steps.dtypes)["b"]).alias("b"))
    events = settled(back.distinct().unionByName(nodes.join(back.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("at"), F.lit(None).cast("bigint").alias("to"), "b")))
    order = Window.partitionBy("conv_id").orderBy("at", F.col("b").isNotNull())
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("reach", reach).withColumn("begins", F.when(F.col("to").isNotNull() & (F.col("reach").isNull() | (F.col("at") > F.col("reach"))), F.col("at")))
    within = events.withColumn("stretch", F.max("begins").over(order)).where("b is not null and reach >= at").select("conv_id", "b", "stretch")
    within = settled(within)
    ends = lambda end: within.select("conv_id", F.col("b").alias(end), F.col("stretch").alias(f"stretch_{end}"))
    steps = steps.join(ends("a"), ["conv_id", "a"]).join(ends("b"), ["conv_id", "b"]).where("stretch_a = stretch_b").select("conv_id", "a", "b", F.col("stretch_a").alias("stretch"))
    steps = settled(steps)
    long = settled(within.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STRETCH).select("conv_id", "stretch"))
    if long.isEmpty():
        return settled(_paths(steps.drop("stretch")).where("a = b").select("conv_id", "b"))
    short = steps.join(long, ["conv_id", "stretch"], "left_anti").drop("stretch")
    kept = settled(_endless(steps.join(long, ["conv_id", "stretch"], "left_semi").drop("stretch")).unionByName(short))
    return settled(_paths(kept).where("a = b").select("conv_id", "b"))


def _endless(steps: DataFrame) -> DataFrame:
    """The steps between calls that are on or behind a cycle, and on or before one: there the longest path grows beyond the number of calls."""
    steps = settled(steps)
    every = steps.select("conv_id", "b").unionAll(steps.select("conv_id", F.col("a").alias("b"))).distinct()
    nodes = settled(every.join(every.groupBy("conv_id").agg((F.count(F.lit(1)) + 1).alias("most")), "conv_id").withColumn("p", _place(F.lit(0).cast("bigint"), F.lit(0))))
    one = [_place(F.lit(0).cast("bigint"), F.lit(1)).alias("c"), F.lit(1).cast("bigint").alias("k")]
    for a, b in (("a", "b"), ("b", "a")):
        depth = _least(nodes, steps.select("conv_id", F.col(a).alias("a"), F.col(b).alias("b"), *one))
        endless = settled(depth.join(nodes.select("conv_id", "b", "most"), ["conv_id", "b"]).where(F.col("p.l") >= F.col("most")).select("conv_id", "b"))
        for end in ("a", "b"):
            steps = steps.join(endless.withColumnRenamed("b", end), ["conv_id", end], "left_semi")
        steps = settled(steps)
    return steps


def _paths(steps: DataFrame) -> DataFrame:
    """All (conv_id, a, b) that steps lead from and to."""
    paths, before = steps, -1
    while (now := paths.count()) != before:
        before = now
        x, y = paths.alias("x"), paths.alias("y")
        longer = x.join(y, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.b") == F.col("y.a")))
        paths = settled(paths.unionByName(longer.select("x.conv_id", "x.a", "y.b")).distinct())
    return paths


#: Tools that the turns of a plain conversation amount to.
CONVERSATION_SCHEMAS = {
    "respond": {
        "required": ["chars", "prompt"], "additionalProperties": False,
        "properties": {
            "chars": {"type": "integer"}, "prompt": {"type": "string"}, "turn": {"type": "integer"},
            "options": {"type": "object", "required": ["style"], "properties": {"style": {"type": "string", "enum": ["brief", "plain", "long"]}, "tags": {"type": "array", "items": {"type": "string"}}}},
        },
    },
    "configure": {"required": ["instructions"], "properties": {"instructions": {"type": "string"}}, "additionalProperties": False},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) as calls and results, by a fixed rule on the number n of a text's characters.

    A user's turn calls respond, a system turn configure; an assistant's turn is the result
    of the call one turn before. A user's turn depends on the answer to the user before it (two
    turns back) unless 3 divides n, and on the answer to the one after it if n mod 4 is 1: so some
    calls must move behind later ones, and some stand on cycles. Its arguments name its turn,
    prompt and characters (left out if 7 divides n), a style by n mod 5 ("loud", which isn't
    allowed, at 4) and tags (the first a number, which isn't allowed, if 4 divides n), and an
    unknown key if 11 divides n. Turns of another role, or of none, are neither: they give
    no row, as in the query's SQL. A null text has no characters and is a null prompt.
    """
    name = lambda by: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + by).cast("string"))
    id_ = lambda by: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(by))
    user, system = F.col("role") == "user", F.col("role") == "system"
    n = F.coalesce(F.char_length("text"), F.lit(0))
    turn = F.coalesce(F.col("turn").cast("string"), F.lit("null"))
    style = F.element_at(F.array(*map(F.lit, ("brief", "plain", "long", "plain", "loud"))), n % 5 + 1)
    ask = F.concat(
        F.lit('{"turn":'), turn, F.lit(',"prompt":'), json_text(F.col("text")), F.when(n % 7 != 0, F.concat(F.lit(',"chars":'), n.cast("string"))).otherwise(""),
        F.when(n % 11 == 0, ',"debug":true').otherwise(""), F.lit(',"options":{"style":"'), style, F.lit('","tags":['), F.when(n % 4 == 0, F.concat(turn, F.lit(","))).otherwise(""), F.lit('"x"]}}'),
    )
    needs = F.filter(F.array(F.when(n % 3 != 0, id_(-2)), F.when(n % 4 == 1, id_(2))), lambda x: x.isNotNull())
    calls = turns.where(user | system).select(
        "conv_id", id_(0).alias("call_id"), "turn", F.when(user, "respond").otherwise("configure").alias("name"),
        F.when(user, ask).otherwise(F.to_json(F.struct(F.col("text").alias("instructions")))).alias("arguments"), F.when(user, needs).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    return calls, turns.where(F.col("role") == "assistant").select("conv_id", id_(-1).alias("call_id"), "turn", F.col("text").alias("content"))
