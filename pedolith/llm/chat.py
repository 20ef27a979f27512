"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import forget, keep

ENVELOPE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
KINDS = {"string": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def items(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> a row per message, call and result: conv_id, turn, idx, kind, role,
    call_id, name, arguments, deps, content.

    A text that is a JSON object with tool_calls or tool_call_id is an envelope; any other text, and
    one that does not parse, is content. Within a turn the message stands first, then its calls in
    order. A call's deps are the ids that it names in depends_on."""
    text = F.coalesce("text", F.lit(""))
    m = messages.select("conv_id", "turn", "role", text.alias("text"))
    m = m.withColumn("e", F.when(F.ltrim("text").startswith("{"), F.from_json("text", ENVELOPE)))
    calls, of = F.col("e.tool_calls"), F.col("e.tool_call_id")
    is_envelope = calls.isNotNull() | of.isNotNull()
    nothing = F.array().cast("array<string>")
    no = F.lit(None).cast("string")

    def item(kind, idx, call_id, name, arguments, deps, content):
        return F.struct(F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), deps.alias("deps"), content.alias("content"))

    message = F.when(of.isNull(), F.array(item("message", F.lit(0), no, no, no, nothing, F.when(is_envelope, F.col("e.content")).otherwise(F.col("text")))))
    result = F.when(of.isNotNull(), F.array(item("result", F.lit(0), of, no, no, nothing, F.col("e.content"))))
    called = F.transform(F.coalesce(calls, F.array().cast("array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>")), lambda c, i: item("call", i + 1, c["id"], c["name"], c["arguments"], F.coalesce(c["depends_on"], nothing), no))
    return m.select("conv_id", "turn", "role", F.explode(F.concat(F.coalesce(message, result), called)).alias("x")).select("conv_id", "turn", "role", "x.*")


def _errors(arguments: Column, params: Column) -> Column:
    """What is wrong with a call's arguments: one entry each, sorted by the argument's name."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    values = F.when(is_object, parsed.cast("map<string,variant>"))
    names = F.coalesce(F.map_keys(values), F.array().cast("array<string>"))
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(names, p["arg"])), lambda p: F.concat(p["arg"], F.lit(": missing")))
    unknown = F.transform(F.array_except(names, F.transform(params, lambda p: p["arg"])), lambda a: F.concat(a, F.lit(": unknown")))
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    bad = lambda p: F.array_contains(names, p["arg"]) & ~F.coalesce(F.rlike(F.schema_of_variant(F.element_at(values, p["arg"])), F.element_at(kinds, p["type"])), F.lit(False))
    mistyped = F.transform(F.filter(params, bad), lambda p: F.concat(p["arg"], F.lit(": not "), p["type"]))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(is_object, F.lit(False)), F.sort_array(F.concat(F.coalesce(missing, none), F.coalesce(unknown, none), F.coalesce(mistyped, none)))).otherwise(F.array(F.lit("arguments: no object")))


def _ordered(linked: DataFrame) -> DataFrame:
    """linked with place (turn, depth): after the item's own turn and after everything that it needs.

    An item in its natural place stays there. Items that come before what they need move, round by
    round, to just after it; only items that some edge reaches take part, and where no edge points
    forward nothing is computed. Rounds are as many as the longest chain of moved items. A cycle is
    cut at the items whose depth passes the number of their conversation's edges: they are set
    back to their own turn and marked on_cycle, the others of the cycle follow them."""
    key = ["conv_id", "turn", "idx"]
    node = F.struct(*key)
    # result <- its call; call <- the results of the calls in its deps, or those calls where no result is
    firsts = linked.where("status in ('linked', 'unanswered') and kind = 'call'").select("conv_id", F.col("call_id").alias("of"), F.col("turn").alias("c_turn"), F.col("idx").alias("c_idx"))
    results = linked.where("status = 'linked' and kind = 'result'").select("conv_id", F.col("call_id").alias("of"), F.col("turn").alias("r_turn"), F.col("idx").alias("r_idx"))
    ends = firsts.join(results, ["conv_id", "of"], "left")
    own = linked.where("status = 'linked' and kind = 'result'").select("conv_id", F.col("call_id").alias("of"), node.alias("v"))
    own = own.join(firsts, ["conv_id", "of"]).select("v", F.struct("conv_id", F.col("c_turn").alias("turn"), F.col("c_idx").alias("idx")).alias("u"))
    needs = linked.where("status in ('linked', 'unanswered') and kind = 'call'").select("conv_id", node.alias("v"), F.explode("deps").alias("of"))
    needs = needs.join(ends, ["conv_id", "of"]).select("v", F.struct("conv_id", F.coalesce("r_turn", "c_turn").alias("turn"), F.coalesce("r_idx", "c_idx").alias("idx")).alias("u"))
    edges = keep(own.unionByName(needs).where("v <> u").distinct(), "edges")
    place = lambda n: F.struct(F.col(f"{n}.turn").alias("turn"), F.lit(0).alias("depth"), F.col(f"{n}.turn").alias("own"), F.col(f"{n}.idx").alias("idx"))
    if edges.where(place("u") >= place("v")).isEmpty():
        return linked.withColumns({"order_turn": F.col("turn"), "order_depth": F.lit(0), "on_cycle": F.lit(False)})
    sizes = edges.groupBy("v.conv_id").agg(F.count("*").alias("most"))
    state = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("place", place("v"))
    state = keep(state.join(sizes, F.col("v.conv_id") == sizes.conv_id, "left").select("v", "place", "most"), "places")
    while True:
        pushed = edges.join(state.select(F.col("v").alias("u"), F.col("place").alias("before"), F.col("most").alias("m")), "u")
        pushed = pushed.where("before.depth <= m").groupBy("v").agg(F.max("before").alias("before"))
        after = F.struct(F.col("before.turn").alias("turn"), (F.col("before.depth") + 1).alias("depth"), F.col("place.own").alias("own"), F.col("place.idx").alias("idx"))
        moves = F.col("before").isNotNull() & (F.col("place") <= F.col("before")) & (F.col("place.depth") <= F.col("most"))
        new = keep(state.join(pushed, "v", "left").select("v", F.when(moves, after).otherwise(F.col("place")).alias("place"), "most", moves.alias("moved")), "places")
        forget(state)
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    state = state.select(F.col("v.conv_id").alias("conv_id"), F.col("v.turn").alias("turn"), F.col("v.idx").alias("idx"), "place", (F.col("place.depth") > F.col("most")).alias("cyclic"))
    out = linked.join(state, key, "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    stays = F.col("place").isNull() | cyclic
    return out.withColumns({"order_turn": F.when(stays, F.col("turn")).otherwise(F.col("place.turn")), "order_depth": F.when(stays, F.lit(0)).otherwise(F.col("place.depth")), "on_cycle": cyclic}).drop("place", "cyclic")


def link_tool_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """A row per message, call and result of messages(conv_id, turn, role, text): conv_id, turn, idx, kind, role,
    call_id, name, status, errors, order_turn, order_depth, on_cycle, json.

    Calls and results are joined on (conv_id, id): status is linked, unanswered (a call without
    result), orphan (a result without call) or duplicate (an id's calls after the first, its results
    after the first); messages are plain. tools(name, params array<struct<arg, type, required>>)
    validates arguments: unknown tools, missing, unknown and mistyped arguments are errors.

    (order_turn, order_depth, turn, idx) is a topological order within a conversation: a result
    after its call, a call after the results that it depends on, everything else in turn. json is
    the item in canonical form: sorted keys, no white space. Rows, not conversations, are the unit:
    no conversation is gathered into one row or task.

    Null text is an empty message. Items without id are unanswered or orphan. Repeated rows repeat their
    messages; their calls and results count as duplicates of the first in (turn, idx, content) order, one of
    equal ones being the first. Other columns are ignored; an empty table gives an empty result. The
    order takes a round of joins for each link of the longest chain of items that had to move.
    """
    x = keep(items(messages).withColumn("uid", F.monotonically_increasing_id()), "items")
    # rows that share turn and index: by content, then any of equal ones, which no column tells apart
    content = F.xxhash64("kind", "role", "call_id", "name", "arguments", "deps", "content")
    x = x.withColumn("here", F.struct("turn", "idx", content.alias("content"), "uid")).drop("uid")
    calls, results = (x.where(F.col("kind") == k).where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("here").alias(f"first_{k}")) for k in ("call", "result"))
    pairs = calls.join(results, ["conv_id", "call_id"], "full")
    plain = x.where("kind = 'message'").withColumns({"status": F.lit("plain"), "errors": F.array().cast("array<string>")}).drop("here")
    t = x.where("kind <> 'message'").join(pairs, ["conv_id", "call_id"], "left")
    here = F.col("here")
    status = (
        F.when((F.col("kind") == "call") & (here != F.col("first_call")), F.lit("duplicate"))
        .when((F.col("kind") == "result") & (here != F.col("first_result")), F.lit("duplicate"))
        .when((F.col("kind") == "call") & F.col("first_result").isNull(), F.lit("unanswered"))
        .when((F.col("kind") == "result") & F.col("first_call").isNull(), F.lit("orphan"))
        .otherwise(F.lit("linked"))
    )
    t = t.withColumn("status", status).drop("first_call", "first_result", "here")
    known = keep(tools.select(F.col("name").alias("tool"), "params"), "tools")
    t = t.join(known, F.col("name") == F.col("tool"), "left")
    errors = F.when(F.col("kind") != "call", F.array().cast("array<string>")).when(F.col("tool").isNull(), F.array(F.lit("name: unknown tool"))).otherwise(_errors(F.col("arguments"), F.col("params")))
    t = t.withColumn("errors", errors).drop("tool", "params")
    out = _ordered(keep(plain.unionByName(t), "linked"))
    body = F.struct(
        F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw")))).alias("arguments"),
        "call_id", "content", "kind", "name", "role",
    )
    text = F.to_json(body.dropFields("arguments"))
    # arguments are JSON already: placed as they are, first in the sorted keys
    json = F.when(F.col("kind") == "call", F.concat(F.lit('{"arguments":'), body["arguments"], F.lit(","), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)
    return out.select("conv_id", "turn", "idx", "kind", "role", "call_id", "name", "status", "errors", "order_turn", "order_depth", "on_cycle", json.alias("json"))


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations in envelopes, every row of them: a user's turn calls a tool with its text, an assistant's
    turn is the result of the call of the turn before; other roles stay plain.

    Calls go to the tools of REPLY and depend on the call two turns before, unless that depends on them. So that linking has all
    its cases to tell, the remainder of 7 * conv_id + 13 * turn by 16 makes some of them differ:
    0 no `turn` argument, 1 `turn` as a string, 2 an argument too many, 3 an unknown tool, 4 arguments
    that are no object, 5 the call twice, 6 it depends on the call two turns later, 7 (assistant) the result
    of a call that is not there, 8 (assistant) a second result for the call three turns before, 9 two calls,
    the first in need of the second. Null text counts as empty, a null conversation or turn as remainder
    10; repeated rows repeat; an empty table stays empty."""
    text = F.coalesce("text", F.lit(""))
    case_at = lambda turn: F.coalesce(F.pmod(7 * F.col("conv_id") + 13 * turn, F.lit(16)), F.lit(10)).cast("int")
    case = case_at(F.col("turn"))
    call_id = lambda turn, more="": F.concat(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")), F.lit(more))
    turn = F.col("turn")
    arguments = (
        F.when(case == 0, F.to_json(F.struct(text.alias("prompt"))))
        .when(case == 1, F.to_json(F.struct(text.alias("prompt"), turn.cast("string").alias("turn"))))
        .when(case == 2, F.to_json(F.struct(text.alias("prompt"), turn.alias("turn"), F.lit(True).alias("loud"))))
        .when(case == 4, F.to_json(F.array(text)))
        .otherwise(F.to_json(F.struct(text.alias("prompt"), turn.alias("turn"))))
    )
    deps = F.when(case == 6, F.array(call_id(turn + 2))).when(case == 9, F.array(call_id(turn, ":b"))).when((turn >= 2) & (case_at(turn - 2) != 6), F.array(call_id(turn - 2)))
    name = F.when(case == 3, F.lit("answer")).otherwise(F.lit("reply"))
    call = F.struct(call_id(turn).alias("id"), name.alias("name"), arguments.alias("arguments"), deps.alias("depends_on"))
    second = F.struct(call_id(turn, ":b").alias("id"), F.lit("look_up").alias("name"), F.to_json(F.struct(text.alias("query"))).alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
    calls = F.when(case == 5, F.array(call, call)).when(case == 9, F.array(call, second)).otherwise(F.array(call))
    asked = F.to_json(F.struct(calls.alias("tool_calls")))
    of = F.when(case == 7, call_id(turn, ":none")).when(case == 8, call_id(turn - 3)).otherwise(call_id(turn - 1))
    answered = F.to_json(F.struct(of.alias("tool_call_id"), text.alias("content")))
    return conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered).otherwise(text).alias("text"))


#: The tools that turns_as_calls() calls.
REPLY = """
select 'reply' as name, array(named_struct('arg', 'prompt', 'type', 'string', 'required', true), named_struct('arg', 'turn', 'type', 'integer', 'required', true)) as params
union all select 'look_up', array(named_struct('arg', 'query', 'type', 'string', 'required', true))
"""
