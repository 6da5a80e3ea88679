"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions only. Calls and results meet in a hash join on their
identifier. The order within a conversation is by (level, position): a call's
level grows by one for each call it needs that stands after it, so calls that
stand in a workable order need no iteration, and only conversations with such
late needs take part in the rounds that find the levels. Chains are halved in
each round; calls that no round can settle wait for themselves. Steps are
counted in two stages, so a conversation with a third of all turns is cut
into ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendgrain.llm.common import stored

RANGE = 512  # positions counted together

# JSON types by the names that Spark gives to parsed values.
TYPES = {
    "string": "^STRING$",
    "integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$",
    "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}

Schemas = dict[str, dict[str, tuple[str, bool]]]

#: Tools of ``tool_events``: for each argument its type and whether it is required.
TOOLS: Schemas = {
    "count_words": {"text": ("string", True), "words": ("integer", True)},
    "find_word": {"word": ("string", True), "limit": ("integer", False), "exact": ("boolean", False)},
    "translate": {"text": ("string", True), "to": ("string", True)},
}


def tool_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off the turns of ``conversations(conv_id, turn, role, text)``.

    Each user turn is a request to a tool, and each assistant turn the result
    of the request in the turn before it. Tool, arguments and needs follow
    from the text: a request needs the one before it if its checksum leaves 0
    when divided by 3, and the one after it if that leaves 5 when divided by
    11. Some arguments are missing, of the wrong type or not JSON.

    Turns with any other role, or none, carry no events and give no rows.
    Turns without a number have a null call_id, so only equal ones are one row.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    named = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    mark = F.crc32(text.cast("binary"))
    words = F.regexp_count(text, F.lit(r"\S+"))
    first = F.regexp_extract(text, r"(\S*)", 1)
    tools = F.array(*[F.lit(t) for t in sorted(TOOLS)])
    arguments = (
        F.when(mark % 29 == 0, F.concat(F.lit("{broken "), first))
        .when(mark % 3 == 0, F.to_json(F.struct(words.alias("words"), F.when(mark % 7 > 0, first).alias("text"))))
        .when(mark % 3 == 1, F.to_json(F.struct(first.alias("word"), (mark % 2 == 0).alias("exact"), F.when(mark % 5 == 0, first).alias("limit"))))
        .otherwise(F.to_json(F.struct(F.when(mark % 13 == 0, F.lit("en")).otherwise(F.lit("fr")).alias("to"), first.alias("text"), F.when(mark % 17 == 0, words).alias("tone"))))
    )
    needs = F.array_compact(F.array(F.when((mark % 3 == 0) & (turn >= 2), named(turn - 2)), F.when(mark % 11 == 5, named(turn + 2))))
    calls = conversations.where("role = 'user'").select(
        conv.alias("conv"), turn.alias("position"), named(turn).alias("call_id"), F.element_at(tools, (mark % 3 + 1).cast("int")).alias("name"), arguments.alias("arguments"), needs.alias("needs")
    )
    results = conversations.where("role = 'assistant'").select(conv.alias("conv"), turn.alias("position"), named(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results


def _errors(schemas: Schemas) -> Column:
    """What is wrong with ``name`` and the parsed ``value`` of its arguments: a sorted list."""
    cases = F.when(F.col("value").isNull() | ~F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False)), F.array(F.lit("arguments are not an object")))
    for tool, fields in schemas.items():
        found = []
        for name, (kind, required) in fields.items():
            own = F.try_variant_get("value", f"$['{name}']", "variant")
            there = own.isNotNull() & (F.schema_of_variant(own) != "VOID")
            if required:
                found.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"missing {name}")))
            found.append(F.when(there & ~F.schema_of_variant(own).rlike(TYPES[kind]), F.lit(f"{name} is not {kind}")))
        known = F.array(*[F.lit(name) for name in fields]) if fields else F.expr("cast(array() as array<string>)")
        other = F.transform(F.array_except(F.json_object_keys("arguments"), known), lambda k: F.concat(F.lit("unknown "), k))
        cases = cases.when(F.col("name") == tool, F.array_sort(F.concat(F.array_compact(F.array(*found)), F.coalesce(other, F.expr("cast(array() as array<string>)")))))
    return cases.otherwise(F.array(F.lit("unknown tool")))


def _shortened(single: DataFrame) -> DataFrame:
    """``conv, id, to, more, base`` with ``to`` the first call on the way that is no single; none for rows that go in circles.

    single: calls that wait for one other, at a level of base at least and more
    than that of ``to``. Ways double in length each round.
    """
    ways, moving = single, -1
    while True:
        on = ways.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("to").alias("end"), F.col("more").alias("on_more"), F.col("base").alias("on_base"))
        on = ways.join(on, (F.col("conv") == F.col("c")) & (F.col("to") == F.col("i")), "left")
        further = F.col("i").isNotNull()
        base = F.greatest("base", F.coalesce(F.col("on_base") + F.col("more"), F.col("base")))
        more = F.col("more") + F.coalesce("on_more", F.lit(0))
        new = stored(on.select("conv", "id", F.coalesce("end", "to").alias("to"), more.alias("more"), base.alias("base"), further.alias("further")), "ways")
        ways, before, moving = new.drop("further"), moving, new.where("further").count()
        if moving in (0, before):  # what still moves after a round in which no way ended, never ends
            return new.where("not further").drop("further")


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv, call_id, level, circular`` of the calls of conversations with late needs; edges: conv, need, call_id, late.

    A round settles the calls without open needs, and hangs each call with one
    open need on the call at the end of its chain; what is needed of a hanging
    call is then needed of that end. Calls left when no round changes anything
    wait for themselves, and so do those that hang on them. Chains and
    circles of any length take a number of steps that grows with the logarithm;
    only calls with several needs that nest deeply take a round per depth.
    """
    late = edges.where("late = 1").groupBy("conv").agg(F.count("*").alias("bound"))
    late = late.select(F.col("conv").alias("own"), "bound")
    every = stored(calls.join(late, F.col("conv") == F.col("own")).select("conv", F.col("call_id").alias("id"), "bound"), "level")
    open_ = every.select("conv", "id", F.lit(0).cast("long").alias("base"))
    edges = edges.join(late, F.col("conv") == F.col("own"), "left_semi")
    edges = stored(edges.select("conv", F.col("call_id").alias("id"), "need", F.col("late").cast("long").alias("more")), "edges")
    of = lambda x: (F.col("conv") == F.col("c")) & (F.col(x) == F.col("i"))
    named = lambda df, *more: df.select(F.col("conv").alias("c"), F.col("id").alias("i"), *more)
    settled, hanging = [], []
    while True:
        free = stored(open_.join(named(edges).distinct(), of("id"), "left_anti").select("conv", "id", F.col("base").alias("level")), "free")
        edges = edges.join(named(free, F.col("level").alias("below")), of("need"), "left")
        waits = F.col("below").isNull()
        left = edges.groupBy("conv", "id").agg(
            F.max(F.col("below") + F.col("more")).alias("up"), F.count_if(waits).alias("needs"), F.max(F.when(waits, F.col("need"))).alias("to"), F.max(F.when(waits, F.col("more"))).alias("more")
        )
        left = named(left, "up", "needs", "to", "more")
        state = stored(open_.join(left, of("id")).select("conv", "id", F.greatest("base", F.coalesce("up", F.lit(0))).alias("base"), "needs", "to", "more"), "open")
        single = state.where("needs = 1").drop("needs")
        found = [not free.isEmpty(), not single.isEmpty()]
        if found[0]:
            settled.append(free)
        if not any(found):
            break
        ends = _shortened(single) if found[1] else single
        if found[1]:
            hanging.append(ends)
        several = state.where("needs <> 1").select("conv", "id", "base")
        kept = edges.where(waits).select("conv", "id", "need", "more").join(named(several), of("id"), "left_semi")
        over = kept.join(named(ends, "to", F.col("more").alias("on"), F.col("base").alias("least")), of("need"), "left")
        over = over.select("conv", "id", F.coalesce("to", "need").alias("need"), (F.col("more") + F.coalesce("on", F.lit(0))).alias("more"), (F.col("least") + F.col("more")).alias("up"))
        edges = stored(over.groupBy("conv", "id", "need").agg(F.max("more").alias("more"), F.max("up").alias("up")), "edges")
        gained = named(edges.groupBy("conv", "id").agg(F.max("up").alias("up")), "up")
        open_ = several.join(gained, of("id"), "left").select("conv", "id", F.greatest("base", F.coalesce("up", F.lit(0))).alias("base"))
        open_, edges = stored(open_, "several"), edges.drop("up")
        if open_.isEmpty():
            break
    level = reduce(DataFrame.unionByName, settled) if settled else every.limit(0).select("conv", "id", F.col("bound").alias("level"))
    for ends in reversed(hanging):
        below = ends.join(level.select(F.col("conv").alias("c"), F.col("id").alias("i"), "level"), of("to"))
        level = stored(level.unionByName(below.select("conv", "id", F.greatest("base", F.col("level") + F.col("more")).alias("level"))), "level")
    out = every.join(named(level, "level"), of("id"), "left")
    return out.select("conv", F.col("id").alias("call_id"), F.coalesce("level", F.col("bound") + 1).alias("level"), F.col("level").isNull().alias("circular"))


def _numbered(rows: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``before``: the sum of weight over the rows of a conversation that stand before one, by ``order``, the last of which is unique."""
    *coarse, position, last = order
    rows = rows.withColumn("slot", F.floor(F.col(position) / RANGE))
    sums = rows.groupBy("conv", *coarse, "slot").agg(F.sum(weight).alias("held"))
    over = Window.partitionBy("conv").orderBy(*coarse, "slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("outer", F.coalesce(F.sum("held").over(over), F.lit(0)))
    sums = sums.select(F.col("conv").alias("c"), *[F.col(x).alias(f"own_{x}") for x in coarse], F.col("slot").alias("s"), "outer")
    inside = Window.partitionBy("conv", *coarse, "slot").orderBy(position, last).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = (F.col("conv") == F.col("c")) & F.col("slot").eqNullSafe(F.col("s"))
    for x in coarse:
        same &= F.col(x) == F.col(f"own_{x}")
    return rows.join(sums, same).withColumn("before", F.col("outer") + F.col("inner")).drop("c", "s", "slot", "outer", "inner", *[f"own_{x}" for x in coarse])


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``conv, step, kind, call_id, name, valid, errors, repeats, json``: a row per call and per result, in a workable order.

    calls: conv, position, call_id, name, arguments (JSON text), needs (ids of
    calls of the conversation); results: conv, position, call_id, content.
    schemas: for each tool its arguments with type and whether required.

    Every call is followed by its result. Needed calls come first. Results
    without a call come last, those that wait for themselves before them.
    Rows with the same conv and call_id count once: the smallest by position,
    then content; repeats counts the others. Null ids never match; such calls
    and results stand for themselves, and equal ones are one row. A null
    conversation is one conversation. Arguments that are no JSON object are
    kept as text. JSON has sorted keys, no spaces, and no null fields. Needs of
    unknown calls, unknown tools, missing, mistyped and unknown arguments are
    errors. Empty tables give no rows.
    """
    nobody = F.lit("")
    conv = F.coalesce(F.col("conv").cast("string"), nobody)
    position = F.coalesce(F.col("position").cast("long"), F.lit(-1))
    c = calls.select(conv.alias("conv"), F.col("call_id").cast("string").alias("call_id"), F.struct(position.alias("position"), "name", "arguments", F.coalesce("needs", F.expr("cast(array() as array<string>)")).alias("needs")).alias("row"))
    r = results.select(conv.alias("conv"), F.col("call_id").cast("string").alias("call_id"), F.struct(position.alias("position"), "content").alias("row"))
    alone = F.when(F.col("call_id").isNull(), F.to_json("row"))
    c = c.groupBy("conv", "call_id", alone.alias("alone")).agg(F.min("row").alias("row"), (F.count("*") - 1).alias("repeats"))
    r = r.groupBy("conv", "call_id", alone.alias("alone")).agg(F.min("row").alias("row"), (F.count("*") - 1).alias("repeats"))
    key = F.coalesce(F.concat(F.lit("="), F.col("call_id")), F.concat(F.lit("?"), F.col("alone")))
    c = stored(c.select("conv", "call_id", key.alias("key"), "row.*", "repeats"), "calls")
    r = stored(r.select("conv", "call_id", key.alias("key"), "row.*", "repeats"), "results")

    wanted = c.select("conv", F.col("call_id"), F.col("position").alias("at"), F.explode("needs").alias("need")).where("call_id is not null").distinct()
    there = c.where("call_id is not null").select(F.col("conv").alias("of"), F.col("call_id").alias("id"), F.col("position").alias("need_at"))
    edges = wanted.join(there, (F.col("conv") == F.col("of")) & (F.col("need") == F.col("id")), "left")
    edges = stored(edges.select("conv", "call_id", "need", F.when(F.col("id").isNull(), None).when(F.col("need_at") < F.col("at"), 0).otherwise(1).alias("late")), "needs")
    unknown = edges.where("late is null").groupBy("conv", "call_id").agg(F.count("*").alias("lost"))
    unknown = unknown.select(F.col("conv").alias("uc"), F.col("call_id").alias("ui"), "lost")
    level = _levels(c.where("call_id is not null"), edges.where("late is not null"))
    level = level.select(F.col("conv").alias("lc"), F.col("call_id").alias("li"), "level", "circular")
    answered = r.where("call_id is not null").select(F.col("conv").alias("rc"), F.col("call_id").alias("ri"), "content", F.col("repeats").alias("result_repeats"))
    rows = c.join(answered, (F.col("conv") == F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    rows = rows.join(level, (F.col("conv") == F.col("lc")) & (F.col("call_id") == F.col("li")), "left")
    rows = rows.join(unknown, (F.col("conv") == F.col("uc")) & (F.col("call_id") == F.col("ui")), "left")
    rows = rows.withColumns({"has": F.col("ri").isNotNull(), "level": F.coalesce("level", F.lit(0)), "value": F.try_parse_json("arguments")})
    more = F.array_compact(F.array(F.when(F.col("lost") > 0, F.lit("needs an unknown call")), F.when(F.col("circular"), F.lit("waits for itself")), F.when(~F.col("has"), F.lit("no result"))))
    rows = rows.withColumns({"errors": F.concat(_errors(schemas), more), "group": F.lit(0), "rows": F.when(F.col("has"), 2).otherwise(1)})
    call_json = F.to_json(F.struct(F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value")).alias("arguments"), F.col("call_id").alias("id"), "name", "needs", F.when(~F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False)), F.col("arguments")).alias("text"), F.lit("call").alias("type")))
    result_json = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")))
    rows = rows.select("conv", "group", "level", "position", "key", "rows", "call_id", "name", "errors", "repeats", call_json.alias("call_json"), F.when(F.col("has"), result_json).alias("result_json"), F.coalesce("result_repeats", F.lit(0)).alias("result_repeats"))

    known = c.where("call_id is not null").select(F.col("conv").alias("of"), F.col("call_id").alias("id"))
    orphans = r.join(known, (F.col("conv") == F.col("of")) & (F.col("call_id") == F.col("id")), "left_anti")
    orphans = orphans.select("conv", F.lit(1).alias("group"), F.lit(0).cast("long").alias("level"), "position", "key", F.lit(1).alias("rows"), "call_id", F.lit(None).cast("string").alias("name"), F.array(F.lit("no call")).alias("errors"), F.lit(0).cast("long").alias("repeats"), F.lit(None).cast("string").alias("call_json"), result_json.alias("result_json"), F.col("repeats").alias("result_repeats"))
    every = stored(rows.unionByName(orphans), "rows")
    every = _numbered(every, ["group", "level", "position", "key"], "rows")
    empty = F.expr("cast(array() as array<string>)")
    call = F.struct(F.col("before").alias("step"), F.lit("call").alias("kind"), "errors", "repeats", F.col("call_json").alias("json"))
    result = F.struct((F.col("before") + F.when(F.col("call_json").isNotNull(), 1).otherwise(0)).alias("step"), F.lit("result").alias("kind"), F.when(F.col("call_json").isNull(), F.col("errors")).otherwise(empty).alias("errors"), F.col("result_repeats").alias("repeats"), F.col("result_json").alias("json"))
    parts = F.array_compact(F.array(F.when(F.col("call_json").isNotNull(), call), F.when(F.col("result_json").isNotNull(), result)))
    out = every.select("conv", "call_id", "name", F.explode(parts).alias("x"))
    return out.select("conv", F.col("x.step").cast("long").alias("step"), "x.kind", "call_id", "name", (F.size("x.errors") == 0).alias("valid"), F.array_join("x.errors", "; ").alias("errors"), F.col("x.repeats").cast("long").alias("repeats"), "x.json")
