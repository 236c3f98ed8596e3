"""Chat formatting: tool calls and their results linked, validated, ordered and written as canonical JSON.

A message row has a conversation, a turn, a role, a text and, for calls, ``tool_calls`` (a JSON array of
``{"id", "name", "arguments"}``; arguments an object or its JSON text) or, for results, ``tool_call_id``. Calls and
results of a conversation are joined by identifier. Arguments are checked against the schema of the tool. Calls
are ordered topologically: a call whose arguments hold ``{"$result": "<id>"}`` comes after that call.

Built-in functions only: JSON is parsed to VARIANT, whose objects keep their keys sorted, so writing a
VARIANT out gives the canonical form: sorted keys, no white space, one spelling of every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.llm.common import read, written

#: JSON type of a value, by the name of its VARIANT type.
TYPES = {
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "string": "STRING",
    "boolean": "BOOLEAN",
    "null": "VOID",
    "integer": r"BIGINT|DECIMAL\([0-9]+,0\)",
    "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT",
}


def calls_of(messages: DataFrame) -> DataFrame:
    """``conv_id, id, turn, pos, name, arguments, copies``: a row for each call; of calls that repeat an id in
    a conversation the first (by turn, then place) counts, ``copies`` says how many there are.

    A ``tool_calls`` that is null or no JSON array has no calls; a call without an id is left out, as
    nothing can refer to it.
    """
    each = messages.select(
        "conv_id", "turn", F.posexplode(F.try_variant_get(F.try_parse_json("tool_calls"), "$", "array<variant>")).alias("pos", "call")
    )
    given = F.try_variant_get("call", "$.arguments", "variant")
    as_text = F.try_parse_json(F.try_variant_get("call", "$.arguments", "string"))
    rows = each.select(
        "conv_id",
        F.try_variant_get("call", "$.id", "string").alias("id"),
        "turn",
        "pos",
        F.try_variant_get("call", "$.name", "string").alias("name"),
        F.when(F.schema_of_variant(given) == "STRING", F.to_json(as_text)).otherwise(F.to_json(given)).alias("arguments"),
    ).where("id IS NOT NULL")
    first = F.min(F.struct("turn", "pos", "name", "arguments")).alias("f")
    return rows.groupBy("conv_id", "id").agg(first, F.count(F.lit(1)).alias("copies")).select("conv_id", "id", "f.*", "copies")


def results_of(messages: DataFrame) -> DataFrame:
    """``conv_id, id, result_turn, result, result_copies``: the first result (by turn, then text) of every id."""
    rows = messages.where("role = 'tool' AND tool_call_id IS NOT NULL")
    first = F.min(F.struct(F.col("turn").alias("result_turn"), F.col("text").alias("result"))).alias("f")
    return rows.groupBy("conv_id", F.col("tool_call_id").alias("id")).agg(first, F.count(F.lit(1)).alias("result_copies")).select(
        "conv_id", "id", "f.*", "result_copies"
    )


def violations(arguments: Column, name: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments, sorted; empty if nothing is.

    A schema has ``properties`` (name to JSON type), ``required`` names, and allows other names unless
    ``additional`` is False.
    """
    value = F.try_parse_json(arguments)
    unknown = F.array(F.lit("unknown tool"))
    by_tool = unknown
    for tool, schema in schemas.items():
        checks = []
        for field, kind in schema["properties"].items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            if field in schema.get("required", ()):
                checks.append(F.when(found.isNull(), F.lit(f"missing {field}")))
            checks.append(F.when(found.isNotNull() & ~found.rlike(f"^({TYPES[kind]})$"), F.lit(f"{field} is not {kind}")))
        listed = F.filter(F.array(*checks, F.lit(None).cast("string")), lambda e: e.isNotNull())
        if not schema.get("additional", True):
            allowed = list(schema["properties"])
            other = F.filter(F.json_object_keys(arguments), lambda k: ~k.isin(allowed))
            listed = F.concat(listed, F.transform(other, lambda k: F.concat(F.lit("unexpected "), k)))
        by_tool = F.when(name == tool, listed).otherwise(by_tool)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.array_sort(F.when(is_object, by_tool).otherwise(F.array(F.lit("arguments are no object"))))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, id, level``: 0 for calls that need no other, else one more than the highest they need.

    References to ids that the conversation lacks, and to the call itself, do not count. Calls in a cycle, or after
    one, get no row. Each round settles one level and is written; there are as many as the longest chain.
    """
    needed = F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$result":"([^"]*)"'), F.lit(1))))
    edges = calls.select("conv_id", "id", needed.alias("needs")).where("id <> needs")
    known = calls.select("conv_id", F.col("id").alias("needs"))
    edges = written(edges.join(known, ["conv_id", "needs"], "left_semi"), "call-edges")
    settled = written(
        calls.select("conv_id", "id").join(edges, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "call-levels"
    )
    rounds = [settled]
    while True:
        done = reduce(DataFrame.union, rounds)
        waiting = edges.join(done.withColumnsRenamed({"id": "needs"}), ["conv_id", "needs"], "left").join(
            done.select("conv_id", "id"), ["conv_id", "id"], "left_anti"
        )
        ready = waiting.groupBy("conv_id", "id").agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = written(ready.where("open = 0").select("conv_id", "id", (F.col("level") + 1).alias("level")), "call-levels")
        if new.isEmpty():
            return done
        rounds.append(new)


def linked_calls(messages: DataFrame, schemas: dict) -> DataFrame:
    """A row for each call and for each result without a call, with ``status, errors, level, json``.

    ``status`` is ``linked``, ``unanswered``, ``early`` (the result stands before its call) or ``orphan`` (a result
    without a call). ``level, turn, pos`` order the calls of a conversation topologically; ``level`` is null for orphans
    and cycles. ``json`` is the canonical JSON of the call with its result. Conversations with a null id
    link nothing. An empty table gives none.
    """
    calls = written(calls_of(messages.where("conv_id IS NOT NULL")), "calls")
    both = calls.join(results_of(messages.where("conv_id IS NOT NULL")), ["conv_id", "id"], "full")
    both = both.join(levels(calls), ["conv_id", "id"], "left")
    is_call = F.col("copies").isNotNull()
    status = (
        F.when(~is_call, "orphan")
        .when(F.col("result_copies").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    errors = F.when(is_call, violations(F.col("arguments"), F.col("name"), schemas)).otherwise(F.array().cast("array<string>"))
    parts = F.struct(F.try_parse_json("arguments").alias("arguments"), "id", "name", "result")
    return both.select(
        "conv_id", "id", "turn", "pos", "name", "result_turn", "copies", "result_copies",
        status.alias("status"), errors.alias("errors"), "level", F.to_json(parts).alias("json"),
    )


#: The tools as which the turns of ``conversations`` are read.
SCHEMAS = {
    "ask": {
        "properties": {"after": "object", "text": "string", "turn": "integer", "words": "integer"},
        "required": ["text", "turn", "words"],
        "additional": False,
    },
    "configure": {"properties": {"text": "string", "turn": "integer"}, "required": ["text", "turn"], "additional": False},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """The table read as tool use: a user turn calls ``ask``, a system turn ``configure``, and an assistant turn is
    the result of the turn before it. A later question refers to the first one of its conversation."""
    first = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    rows = conversations.join(first, "conv_id", "left")

    def name_of(turn):
        return F.concat(F.lit("call_"), F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))))

    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    after = F.when(F.col("turn") > F.col("first_turn"), F.struct(name_of(F.col("first_turn")).alias("$result")))
    ask = F.to_json(F.struct("text", "turn", n_words.alias("words"), after.alias("after")))
    call = F.struct(
        name_of(F.col("turn")).alias("id"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", ask).otherwise(F.to_json(F.struct("turn", "text"))).alias("arguments"),
    )
    is_call = F.col("role").isin("user", "system")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", "tool").otherwise("assistant").alias("role"),
        F.when(~is_call, F.col("text")).alias("text"),
        F.when(is_call, F.to_json(F.array(call))).alias("tool_calls"),
        F.when(F.col("role") == "assistant", name_of(F.col("turn") - 1)).alias("tool_call_id"),
    )


def op4_tool_calls(spark, sf_dir):
    """The turns of all conversations as linked, validated and ordered tool calls."""
    linked = linked_calls(as_tool_messages(read(spark, sf_dir, "conversations")), SCHEMAS)
    return linked.select(
        "conv_id", F.col("id").alias("call_id"), "turn", "name", "result_turn", "status",
        F.array_join("errors", "; ").alias("errors"), F.col("level").cast("int"), "json",
    )


ORACLE_SQL = r"""
WITH firsts AS (SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE role = 'user' GROUP BY 1),
rows AS (
  SELECT c.*, first_turn,
    'call_' || md5(c.conv_id || ':' || turn) AS own, 'call_' || md5(c.conv_id || ':' || first_turn) AS first_id,
    'call_' || md5(c.conv_id || ':' || (turn - 1)) AS answers,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations c LEFT JOIN firsts USING (conv_id)),
calls AS (
  SELECT conv_id, own AS id, turn, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name,
    CASE WHEN role = 'user' THEN
      '{' || CASE WHEN turn > first_turn THEN '"after":{"$result":"' || first_id || '"},' ELSE '' END ||
      '"text":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '}'
    ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END AS arguments,
    CASE WHEN role = 'user' AND turn > first_turn THEN 1 ELSE 0 END AS level
  FROM rows WHERE role IN ('user', 'system')),
results AS (SELECT conv_id, answers AS id, turn AS result_turn, text AS result FROM rows WHERE role = 'assistant')
SELECT conv_id, id AS call_id, turn, name, result_turn,
  CASE WHEN calls.turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  '' AS errors, level::INTEGER AS level,
  '{' || CASE WHEN arguments IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END || '"id":"' || id || '"' ||
    CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END ||
    CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result) END || '}' AS json
FROM calls FULL JOIN results USING (conv_id, id)
"""
