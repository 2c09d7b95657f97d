"""Tool-call linking in DataFrame functions only: join calls with results, order them, validate, serialise.

Calls and results come from two forms of messages. An assistant message that is a JSON object with "tool_calls"
(id, name, arguments, depends_on) makes explicit calls, and a tool message with "tool_call_id" and "content" is a
result. Every other user message is a call of `reply` with the arguments text and turn, whose result is the
assistant message of the next turn; it depends on the call two turns before it, if that is a user message too.

Defined cases: messages with a null conv_id, turn or role make no calls; a null text is a null argument, which the
schema refuses; equal messages count once; explicit calls and results of one id count once, the earliest winning, and
of several plain messages of one (conv_id, turn, role) the least text counts, as in the SQL twin; a call without result and a result without call are rows of their own; calls on a cycle have a null level; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# Argument schemas: call name -> (field, variant types, least value or length).
SCHEMAS = {"reply": (("text", ("STRING",), 1), ("turn", ("BIGINT",), 0))}


def messages_of(conversations: DataFrame) -> DataFrame:
    """The different messages of every conversation, turn and role."""
    kept = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    ).filter("conv_id is not null and turn is not null and role is not null")
    return kept.distinct()


def _least(messages: DataFrame) -> DataFrame:
    """One message per conversation and turn; a null text only where there is no other."""
    return messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, id, turn, name, arguments, depends_on) and results (conv_id, id, turn, content)."""
    parsed = messages.withColumn("json", F.when(F.col("text").startswith("{"), F.try_parse_json("text")))
    asked = F.try_variant_get("json", "$.tool_calls", "array<variant>")
    field = lambda path, kind="string": F.try_variant_get("call", path, kind)
    explicit = parsed.filter("role = 'assistant'").select("conv_id", "turn", F.explode(asked).alias("call")).select(
        "conv_id", field("$.id").alias("id"), "turn", field("$.name").alias("name"),
        F.to_json(field("$.arguments", "variant")).alias("arguments"), field("$.depends_on").alias("depends_on")
    ).filter("id is not null").groupBy("conv_id", "id").agg(
        F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select("conv_id", "id", "c.*")
    plain = _least(messages.filter("role = 'user'")).select(
        "conv_id", F.concat(F.lit("turn-"), "turn").alias("id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"), F.concat(F.lit("turn-"), F.col("turn") - 2).alias("depends_on"))
    given = parsed.filter("role = 'tool'").select(
        "conv_id", F.try_variant_get("json", "$.tool_call_id", "string").alias("id"), "turn",
        F.to_json(F.try_variant_get("json", "$.content", "variant")).alias("content")).filter("id is not null")
    answers = _least(parsed.filter(F.col("role") == "assistant").filter(asked.isNull())).select(
        "conv_id", F.concat(F.lit("turn-"), F.col("turn") - 1).alias("id"), "turn", F.to_json(F.struct(F.col("text").alias("t"))).alias("content"))
    answers = answers.withColumn("content", F.expr("if(content = '{}', 'null', substring(content, 6, length(content) - 6))"))
    results = given.union(answers).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "content")).alias("r")).select(
        "conv_id", "id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    return explicit.union(plain), results


def valid_arguments(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """Whether arguments hold every field of the call's schema in its type; a call without schema is not valid."""
    parsed, out = F.try_parse_json(arguments), F.lit(False)
    for call, fields in schemas.items():
        fits = F.lit(True)
        for field, kinds, least in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            size = F.length(F.try_variant_get(parsed, f"$.{field}", "string")) if kinds == ("STRING",) else (
                F.try_variant_get(parsed, f"$.{field}", "bigint"))
            fits = fits & F.coalesce(F.schema_of_variant(value).isin(*kinds) & (size >= least), F.lit(False))
        out = F.when(name == call, fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level: how many calls must come before this one. Ancestor links double in length each round.

    `calls`: conv_id, id, depends_on; a dependence on no known call does not count. Runs one job a round.
    """
    known = calls.select("conv_id", F.col("id").alias("depends_on"), F.lit(True).alias("known"))
    state = settle(calls.join(known, ["conv_id", "depends_on"], "left").select(
        "conv_id", "id", F.when(F.col("known"), F.col("depends_on")).alias("ancestor"),
        F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("level")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.filter("ancestor is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("level").alias("more"))
        state = settle(state.join(above, ["conv_id", "ancestor"], "left").select(
            "conv_id", "id", F.col("further").alias("ancestor"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return state.select("conv_id", "id", F.when(F.col("ancestor").isNull(), F.col("level")).alias("level"))


def link(conversations: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row a call, or a result without call: conv_id, call_id, level, turn, status, valid, message.

    Inside a conversation (level, turn, call_id) is a topological order. `message` is canonical JSON: sorted keys, no spaces.
    """
    calls, results = calls_and_results(messages_of(conversations))
    calls = settle(calls)
    ordered = calls.join(levels(calls), ["conv_id", "id"])
    linked = ordered.join(results, ["conv_id", "id"], "full")
    status = F.when(F.col("name").isNull(), "orphan result").when(F.col("result_turn").isNull(), "no result").otherwise("linked")
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} as t)), 6, length(to_json(struct({c} as t))) - 6)")
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(',"id":'), quoted("id"),
        F.lit(',"name":'), F.when(F.col("name").isNull(), "null").otherwise(quoted("name")),
        F.lit(',"result":'), F.coalesce("content", F.lit("null")), F.lit("}"))
    return linked.select(
        "conv_id", F.col("id").alias("call_id"), "level", F.coalesce("turn", "result_turn").alias("turn"), status.alias("status"),
        valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"), message.alias("message"))
