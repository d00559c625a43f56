"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log is partitioned by conversation, each message's events are folded in sequence order, and the final
messages are rendered.  Nothing holds more than one message or, at the end, one rendered conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwell.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate")
CHUNK = 64
"""Span of sequence numbers whose turns are joined before a conversation is; only the grouping, never the result, depends on it."""


def escape(text: Column) -> Column:
    """Write ``&`` as ``&amp;`` and ``<|`` as ``&lt;|``: no control string is left, and it can be undone."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, role, text`` of a log ``conv_id, seq, message_id, kind, role, text``.

    Kinds: ``message`` and ``edit`` set the text, ``delta`` appends to it, ``regenerate`` starts it anew,
    ``delete`` removes the message; any other kind, null included, is read as ``delta``.  A message stands
    where its first event stands and has the last role given.  Events of equal sequence number are applied
    in the order kind, role, text; null sequence numbers come first; null texts and roles are empty.
    Rows are grouped by (conversation, message), so a conversation with most of the log is spread.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    folded = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    resets = F.array_max(F.transform("e", lambda x, i: F.when(x["kind"].isin(*RESETS, "delete"), i).otherwise(-1)))
    folded = folded.withColumn("reset", resets)
    live = F.slice("e", F.greatest(F.col("reset"), F.lit(0)) + 1, F.size("e"))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r != "")
    return folded.where((F.col("reset") < 0) | (F.try_element_at("e", F.col("reset") + 1)["kind"] != "delete")).select(
        "conv_id",
        F.col("e")[0]["seq"].alias("seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row ``conv_id, formatted`` per conversation: its messages by seq, role, text in the template.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped (a line break in a role
    too).  Turns are joined first in spans of sequence numbers and then per conversation, so the last step
    gets a few strings of each conversation and not its turns.  An empty log gives no rows.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    turn = F.concat(F.lit(START), role, F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    row = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("plain"), turn.alias("turn"))
    chunks = messages.groupBy("conv_id", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    chunks = chunks.select("conv_id", F.struct("chunk", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("part")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return whole.select("conv_id", F.array_join(F.transform("c", lambda x: x["part"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` that a rendered conversation holds, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    line = lambda b: F.locate("\n", b)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.replace(b.substr(F.lit(len(START) + 1), line(b) - len(START) - 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescape(b.substr(line(b) + 1, F.length(b))).alias("text"),
        ),
    )


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask: those of the assistant."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(extra)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message_id"), F.lit("message").alias("kind"), "role", "text")
    formatted = render(fold_events(events)).withColumn("turns", parse(F.col("formatted")))
    spoken = F.array_join(loss_texts(F.col("turns")), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "length(replace(replace({0}, '&', '&amp;'), '<|', '&lt;|'))"

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {
    "op7_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + 1 + len(END)} + {_ESCAPED.format("r")} + {_ESCAPED.format("t")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
