"""Chat formatting: tool calls linked to their results, ordered, validated and written as JSON lines.

Calls and results meet in a hash join on (conversation, call identifier).  Both sides are reduced to one
row per identifier first, so repeats cannot multiply.  A call may name a parent call of its conversation;
its depth is the length of the chain above it, found by pointer doubling in as many joins as the log of
the longest chain.  Ordered by depth, then turn, every call follows what it depends on.  Arguments are
parsed as a variant, checked against their tool's schema, and written with sorted keys.

There is one line per call, never one per conversation, so a conversation of any size stays spread out.
A line is canonical: its keys are sorted, absent values are null, and nothing is between the tokens.

Defined results: a call without a result is ``pending`` or, where its tool gives none, ``done``; a
result without a call is ``orphan``; a call whose chain of parents never ends is ``cyclic`` with depth
-1; a parent that is not there is noted as a problem and the call counts as a root; of several calls or
results of an identifier the least is kept and their number given; rows without an identifier are
``unidentified`` and stay as they are; arguments that are no JSON object are a problem; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import WORD
from lifelog.staging import stage

#: Tool: field, type, whether it is required.  A tool outside the table is a problem of its own.
SCHEMAS = {
    "configure": (("instructions", "string", True),),
    "reply": (("prompt", "string", True), ("turn", "integer", True), ("words", "integer", True)),
}
#: Tools that give no result.
SILENT = ("configure",)
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def problems(name: Column, arguments: Column, parsed: Column, schemas=SCHEMAS) -> Column:
    """What is wrong with the arguments, by field."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.when(~name.isin(*sorted(schemas)) | name.isNull(), F.array(F.lit("tool")))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, kind, required in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            absent = ~F.array_contains(keys, field)
            wrong = F.coalesce(F.schema_of_variant(value), F.lit("VOID")) != _TYPES[kind]
            checks.append(F.when(absent, F.lit(f"missing:{field}") if required else F.lit(None))
                          .when(wrong, F.lit(f"type:{field}")))
        known = [f for f, _, _ in fields]
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), lambda k: F.concat(F.lit("unknown:"), k))
        found = found.when(name == tool, F.concat(F.filter(F.array(*checks), lambda c: c.isNotNull()), unknown))
    shape = parsed.isNull() | F.json_object_keys(arguments).isNull()
    return F.when(shape, F.array(F.lit("arguments"))).otherwise(found)


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, parent_found) of (conv_id, call_id, parent_id); depth -1 on or below a cycle."""
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"))
    state = (
        calls.join(known, (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("p")), "left")
        .select("conv_id", "call_id", F.col("p").alias("up"), F.col("p").isNotNull().cast("long").alias("depth"),
                (F.col("parent_id").isNull() | F.col("p").isNotNull()).alias("parent_found"))
    )
    state = stage(state, "tool-calls-depth")
    reach, most = 1, state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while reach <= most and state.where("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), F.col("up").alias("next"),
                             F.col("depth").alias("more"))
        state = stage(
            state.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("p")), "left")
            .select("conv_id", "call_id", F.col("next").alias("up"),
                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "parent_found"), "tool-calls-depth")
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).otherwise(-1).alias("depth"), "parent_found")


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS, silent=SILENT) -> DataFrame:
    """Lines for calls (conv_id, call_id, parent_id, turn, name, arguments) and results (conv_id, call_id, turn, content)."""
    key = ["conv_id", "call_id"]
    has = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    once = stage(calls.where(has).groupBy(*key).agg(
        F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("call"), F.count("*").alias("n_calls")), "tool-calls")
    answers = results.where(has).groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    placed = once.join(depths(once.select(*key, "call.parent_id")), key)
    joined = placed.join(answers.hint("shuffle_hash"), key, "full_outer")
    lost = calls.where(~has).select(
        "conv_id", "call_id", F.struct("turn", "name", "arguments", "parent_id").alias("call"), F.lit(1).cast("long").alias("n_calls"))
    lost_results = results.where(~has).select(
        "conv_id", "call_id", F.struct("turn", "content").alias("result"), F.lit(1).cast("long").alias("n_results"))
    every = joined.unionByName(lost, allowMissingColumns=True).unionByName(lost_results, allowMissingColumns=True)

    call, result = F.col("call"), F.col("result")
    parsed = every.withColumn("parsed", F.try_parse_json("call.arguments"))
    wrong = F.when(call.isNull(), F.array().cast("array<string>")).otherwise(F.concat(
        problems(call["name"], call["arguments"], F.col("parsed"), schemas),
        F.when(F.coalesce("parent_found", F.lit(True)), F.array().cast("array<string>")).otherwise(F.array(F.lit("parent")))))
    status = (
        F.when(~has, "unidentified").when(call.isNull(), "orphan").when(F.col("depth") < 0, "cyclic")
        .when(result.isNotNull(), "linked").when(call["name"].isin(*silent), "done").otherwise("pending")
    )
    shown = parsed.select(
        "conv_id", "call_id", F.coalesce(call["turn"], result["turn"]).alias("turn"), "depth", status.alias("status"),
        wrong.alias("problems"), call["name"].alias("name"), call["parent_id"].alias("parent"), F.col("parsed").alias("arguments"),
        result["content"].alias("result"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    line = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", "parent", "problems", "result", "status"),
                     {"ignoreNullFields": "false"})
    return shown.select("conv_id", "call_id", "turn", "depth", "status", F.array_join("problems", ",").alias("problems"),
                        "n_calls", "n_results", line.alias("line"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a conversations table.

    A user turn calls ``reply``, a system turn ``configure``; an assistant turn is the result of the
    turn before it.  A call depends on the call that the turn before it made or answered.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    name = lambda at: F.concat_ws(":", "conv_id", at)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    is_call = F.coalesce(F.col("role") != "assistant", F.lit(True))
    made = rows.select("conv_id", "turn", "role", "text", F.when(known, F.when(is_call, name(F.col("turn"))).otherwise(
        name(F.col("turn") - 1))).alias("call_id"), is_call.alias("is_call"))
    before = made.where(known).groupBy(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).agg(
        F.max("call_id").alias("parent_id"))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("instructions")), {"ignoreNullFields": "false"})).otherwise(
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("words")),
                  {"ignoreNullFields": "false"}))
    calls = (
        made.where("is_call").join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
        .select("conv_id", "call_id", "parent_id", "turn", F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"),
                arguments.alias("arguments"))
    )
    return calls, made.where("NOT is_call").select("conv_id", "call_id", "turn", F.col("text").alias("content"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered and validated calls of every conversation."""
    return link(*conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op10_tool_calls": op10_tool_calls}
ORACLE = {"op10_tool_calls": r"""
WITH RECURSIVE made AS (
  SELECT *, coalesce(role <> 'assistant', true) AS is_call,
         conv_id || ':' || CASE WHEN coalesce(role <> 'assistant', true) THEN turn ELSE turn - 1 END AS call_id FROM conversations),
calls AS (
  SELECT m.conv_id, m.call_id, any_value(b.parent_id) AS parent_id, min(m.turn) AS turn, min(m.role) AS role,
         arg_min(m.text, m.text) AS text, count(*) AS n_calls
  FROM made m LEFT JOIN (SELECT conv_id, turn + 1 AS t, max(call_id) AS parent_id FROM made GROUP BY ALL) b
       ON m.conv_id = b.conv_id AND m.turn = b.t
  WHERE is_call GROUP BY 1, 2),
up AS (SELECT c.conv_id, c.call_id, c.parent_id, p.call_id AS found FROM calls c
       LEFT JOIN calls p ON c.conv_id = p.conv_id AND c.parent_id = p.call_id),
walk(conv_id, call_id, depth) AS (
  SELECT conv_id, call_id, 0 FROM up WHERE found IS NULL
  UNION ALL SELECT u.conv_id, u.call_id, w.depth + 1 FROM up u JOIN walk w ON u.conv_id = w.conv_id AND u.found = w.call_id),
results AS (SELECT conv_id, call_id, min(turn) AS turn, arg_min(text, turn) AS content, count(*) AS n_results
            FROM made WHERE NOT is_call GROUP BY 1, 2),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
         w.depth, coalesce(c.n_calls, 0) AS n_calls, coalesce(r.n_results, 0) AS n_results, c.parent_id, r.content, c.text, c.role,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NOT NULL THEN 'linked' WHEN c.role = 'system' THEN 'done'
              ELSE 'pending' END AS status, c.call_id IS NOT NULL AS has_call, c.turn AS call_turn,
         CASE WHEN c.call_id IS NULL THEN '' ELSE array_to_string(list_filter([
           CASE WHEN c.text IS NULL AND c.role = 'system' THEN 'type:instructions' WHEN c.text IS NULL THEN 'type:prompt' END,
           CASE WHEN c.parent_id IS NOT NULL AND u.found IS NULL THEN 'parent' END], lambda x: x IS NOT NULL), ',') END AS problems
  FROM calls c LEFT JOIN walk w USING (conv_id, call_id) LEFT JOIN up u USING (conv_id, call_id)
       FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, depth::BIGINT AS depth, status, problems, n_calls, n_results,
       '{"arguments":' || CASE WHEN NOT has_call THEN 'null'
            WHEN role = 'system' THEN '{"instructions":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
            ELSE '{"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || call_turn || ',"words":' ||
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) || '}' END ||
       ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || CASE WHEN NOT has_call THEN 'null' WHEN role = 'system' THEN '"configure"' ELSE '"reply"' END ||
       ',"parent":' || coalesce(to_json(parent_id)::VARCHAR, 'null') || ',"problems":' ||
       CASE WHEN problems = '' THEN '[]' ELSE to_json(string_split(problems, ','))::VARCHAR END ||
       ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS line
FROM linked
"""}
