"""Tool-call linking: calls and results joined by identifier, ordered, validated, as canonical JSON.

Everything is DataFrame functions. Calls and results are summed up per identifier, so a repeated
identifier makes no product of rows, and the calls are joined to those sums by hash.

A call is either an element of ``tool_calls`` in a message that is a JSON object (``id``, ``name``,
``arguments`` and, optionally, ``after``: identifiers of calls whose results it needs), or a plain user
turn, which is a call of ``reply`` with its text, named ``conversation:turn``. A result is a JSON object
with ``tool_call_id`` and ``content``, or the assistant's plain turn after a user's. All else is a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

#: Parameters of each tool: name to (type of the value, whether it must be there).
REPLY = {"reply": {"text": ("string", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def quoted(c: Column) -> Column:
    """A string as JSON, null as null."""
    s = F.to_json(F.array(c))
    return F.coalesce(F.when(c.isNotNull(), F.substr(s, F.lit(2), F.length(s) - 2)), F.lit("null"))


def validation(name: Column, arguments: Column, keys: Column, schemas: dict) -> Column:
    """Sorted array of what is wrong with a call's arguments (a variant, null where they are no JSON object)."""
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in sorted(schemas.items()):
        wrong = []
        for p, (kind, needed) in sorted(parameters.items()):
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            there = F.array_contains(keys, p)
            if needed:
                wrong.append(F.when(~there, F.lit(f"missing {p}")))
            wrong.append(F.when(there & ~F.coalesce(F.schema_of_variant(value).rlike(f"^{_TYPES[kind]}$"), F.lit(False)), F.lit(f"type of {p}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        found = F.array_sort(F.concat(F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"), extra))
        out = F.when(name == tool, found).otherwise(out)
    return F.when(keys.isNull(), F.array(F.lit("arguments are no object"))).otherwise(out)


def events(conversations: DataFrame, schemas: dict) -> DataFrame:
    """One row per call, result or message: kind, conv_id, turn, pos, call_id, name, arguments, errors, after, content."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    looks = F.coalesce(F.col("text").rlike(r"^\s*\{"), F.lit(False))
    v = F.when(looks, F.try_parse_json("text"))
    c = c.withColumn("v", v)
    listed = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    answer = F.try_variant_get("v", "$.tool_call_id", "string")
    kind = F.when(listed.isNotNull(), "calls").when(answer.isNotNull(), "result")
    kind = kind.when((F.col("role") == "user") & F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), "ask").when((F.col("role") == "assistant") & F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), "reply").otherwise("message")
    c = c.withColumn("kind", kind)
    own = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    none = F.lit(None).cast("string")
    no_list = F.array().cast("array<string>")
    plain = c.filter("kind <> 'calls'").select(
        F.when(F.col("kind") == "ask", "call").when(F.col("kind").isin("reply", "result"), "result").otherwise("message").alias("kind"),
        "conv_id",
        "turn",
        F.lit(0).alias("pos"),
        F.when(F.col("kind") == "ask", own(0)).when(F.col("kind") == "reply", own(1)).when(F.col("kind") == "result", answer).alias("call_id"),
        F.when(F.col("kind") == "ask", "reply").when(F.col("kind") == "message", F.col("role")).alias("name"),
        F.when(F.col("kind") == "ask", F.when(F.col("text").isNull(), "{}").otherwise(F.concat(F.lit('{"text":'), quoted(F.col("text")), F.lit("}")))).alias("arguments"),
        F.when((F.col("kind") == "ask") & F.col("text").isNull(), F.array(F.lit("missing text"))).otherwise(no_list).alias("errors"),
        no_list.alias("after"),
        F.when(F.col("kind") == "result", F.to_json(F.try_variant_get("v", "$.content", "variant"))).when(F.col("kind") != "ask", quoted(F.col("text"))).alias("content"),
    )
    x = c.filter("kind = 'calls'").withColumn("calls", F.try_variant_get("v", "$.tool_calls", "array<variant>")).select("conv_id", "turn", F.posexplode("calls").alias("pos", "x"))
    arguments = F.try_variant_get("x", "$.arguments", "variant")
    text = F.to_json(arguments)
    x = x.withColumn("a", arguments).withColumn("t", F.when(F.schema_of_variant(arguments).startswith("OBJECT"), text)).withColumn("n", F.try_variant_get("x", "$.name", "string"))
    tools = x.select(
        F.lit("call").alias("kind"),
        "conv_id",
        "turn",
        "pos",
        F.coalesce(F.try_variant_get("x", "$.id", "string"), none).alias("call_id"),
        F.col("n").alias("name"),
        F.coalesce(text, F.lit("null")).alias("arguments"),
        validation(F.col("n"), F.col("a"), F.json_object_keys("t"), schemas).alias("errors"),
        F.coalesce(F.try_variant_get("x", "$.after", "array<string>"), no_list).alias("after"),
        none.alias("content"),
    )
    return plain.unionByName(tools)


def levels(calls: DataFrame) -> DataFrame:
    """call_id and level of the calls that name others in ``after`` (distinct identifiers).

    A call's level is two more than the highest level of what it names, or 0; identifiers that are not
    there don't hold it back. Calls on a cycle, or behind one, get level -1. Each round settles the calls
    all of whose needs are settled; there are as many rounds as the longest chain.
    """
    edges = calls.select(F.col("call_id").alias("dst"), F.explode("after").alias("src")).filter("dst IS NOT NULL AND src IS NOT NULL").distinct()
    edges = checkpointed(edges.join(calls.select(F.col("call_id").alias("src")).distinct(), "src", "left_semi"))
    pending = edges.select("dst").distinct()
    done = edges.select(F.col("src").alias("call_id")).join(pending, F.col("call_id") == F.col("dst"), "left_anti").distinct().select("call_id", F.lit(0).alias("level"))
    done, n = checkpointed(done), -1
    while done.count() != n:
        n = done.count()
        ready = edges.join(done.withColumnRenamed("call_id", "src"), "src", "left").groupBy("dst").agg(F.max("level").alias("m"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
        new = ready.join(done, F.col("dst") == F.col("call_id"), "left_anti").select(F.col("dst").alias("call_id"), (F.col("m") + 2).alias("level"))
        done = checkpointed(done.unionByName(new))
    stuck = pending.join(done, F.col("dst") == F.col("call_id"), "left_anti").select(F.col("dst").alias("call_id"), F.lit(-1).alias("level"))
    return done.unionByName(stuck)


def link(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per call, result without a call, and message.

    conv_id, turn, pos, kind, call_id, level, status, n_results and json. Sorting by level, turn and pos
    puts every call after what it needs. A call is ``linked``, ``pending`` (no result), ``cyclic`` or
    ``ambiguous`` (its identifier is not its alone), and ``invalid`` if nothing else but its arguments is
    wrong; a result is an ``orphan`` where no call has its identifier. Of several results of a call the
    first by turn and content is embedded, and all are counted. Null texts are calls without arguments or
    empty messages, null identifiers are never linked, text that is no JSON is plain (so is JSON beyond the
    size of a variant), an empty table gives no rows; further columns are ignored.
    """
    e = events(conversations, schemas or REPLY)
    ids = e.filter("kind IN ('call', 'result') AND call_id IS NOT NULL")
    sums = ids.groupBy("call_id").agg(
        F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"), F.min(F.when(F.col("kind") == "result", F.struct("turn", "content"))).alias("r")
    )
    calls = e.filter("kind = 'call'")
    named = calls.filter("size(after) > 0 AND call_id IS NOT NULL")
    linked = calls.join(sums.withColumnRenamed("call_id", "id"), F.col("call_id") == F.col("id"), "left")
    if named.isEmpty():
        linked = linked.withColumn("level", F.lit(0))
    else:
        order = levels(calls.select("call_id", "after")).withColumnRenamed("call_id", "of")
        linked = linked.join(order, F.col("call_id") == F.col("of"), "left").withColumn("level", F.coalesce("level", F.lit(0)))
    status = F.when(F.col("level") < 0, "cyclic").when(F.col("n_calls") > 1, "ambiguous").when(F.size("errors") > 0, "invalid").when(F.coalesce("n_results", F.lit(0)) == 0, "pending").otherwise("linked")
    n = F.coalesce("n_results", F.lit(0)).cast("long")
    json = F.concat(
        F.lit('{"arguments":'), F.col("arguments"), F.lit(',"errors":'), F.to_json("errors"), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"level":'), F.col("level").cast("string"),
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), F.coalesce("r.content", F.lit("null")), F.lit("}"),
    )
    first = linked.select("conv_id", "turn", "pos", "kind", "call_id", "level", status.alias("status"), n.alias("n_results"), json.alias("json"))
    has_call = calls.filter("call_id IS NOT NULL").select(F.col("call_id").alias("id")).distinct()
    orphans = e.filter("kind = 'result'").join(has_call, F.col("call_id") == F.col("id"), "left_anti")
    rest = orphans.unionByName(e.filter("kind = 'message'"))
    json = F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"role":'), quoted(F.coalesce("name", F.lit("result"))), F.lit("}"))
    rest = rest.select("conv_id", "turn", "pos", "kind", "call_id", F.lit(0).alias("level"), F.when(F.col("kind") == "result", "orphan").otherwise("message").alias("status"), F.lit(0).cast("long").alias("n_results"), json.alias("json"))
    return first.unionByName(rest)
