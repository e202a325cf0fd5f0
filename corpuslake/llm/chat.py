"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation, put in sequence and folded:
``message`` opens (or replaces) a turn, ``delta`` appends to it, ``edit`` and
``regenerate`` replace its text and discard what was streamed before. The final
messages are rendered with a template whose control strings cannot occur in a
text, because texts are escaped reversibly.

Null text is empty text; a null role is an empty role; a null turn sorts first.
Events that tie on sequence are taken in order of kind, role and text, and
messages that tie on turn in order of role and text, so repeated rows have one
defined result. An empty log gives no rows; extra columns are ignored. Messages
are folded apart from each other, so a conversation that has a third of all
events is folded in many tasks; only its final messages meet, as it ends in one
string. Texts of any length are folded whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings. No escaped text holds "<" or "[".
BEGIN, HEAD_END, END = "<s>[", "]\n", "</s>\n"
#: Escapes, in order of use; undone in reverse order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, turn, role, text) of a log with these columns, ``seq`` and ``kind``.

    ``message`` names the message that an event belongs to and ``turn`` its place.
    Its text is that of the last event that is not a delta, then every later delta
    in order; its role and turn are those of its last event that has them.
    """
    order = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = lambda name: F.max(F.when(F.col(name).isNotNull(), F.struct("seq", name)))[name]
    folded = (
        events.groupBy("conv_id", "message")
        .agg(
            F.sort_array(F.collect_list(order)).alias("log"),
            F.max(F.when(F.coalesce("kind", F.lit("")) != "delta", order)).alias("base"),
            last("role").alias("role"),
            last("turn").alias("turn"),
        )
    )
    later = F.filter("log", lambda e: F.col("base").isNull() | (e > F.col("base")))
    streamed = F.array_join(F.transform(later, lambda e: e["text"]), "")
    text = F.concat(F.coalesce("base.text", F.lit("")), streamed)
    return folded.select("conv_id", "message", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): all messages of a conversation (turn, role, text), by turn; ties by role, then by plain text."""
    piece = F.concat(
        F.lit(BEGIN), escape(F.coalesce("role", F.lit(""))), F.lit(HEAD_END), escape(F.coalesce("text", F.lit(""))), F.lit(END)
    )
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), piece.alias("piece"))
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("all")).select(
        "conv_id", F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("formatted")
    )


def parse(formatted: Column) -> Column:
    """Array of struct(role, text), read back from a rendered conversation."""
    parts = F.filter(F.split(formatted, BEGIN.replace("[", "\\["), -1), lambda p: p != "")

    def one(p: Column) -> Column:
        text_at = F.instr(p, HEAD_END) + len(HEAD_END)
        text = F.substring(p, text_at, F.length(p) - text_at + 1 - len(END))
        return F.struct(unescape(F.substring_index(p, HEAD_END, 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def with_loss(turns: Column, trained: str = "assistant") -> Column:
    """All text under the loss mask: each trained role's text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == trained), lambda t: t["text"]), "")


def event_log(rows: DataFrame) -> DataFrame:
    """The log of events that leads to ``rows`` (conv_id, turn, role, text), one message each.

    An assistant's message is streamed: it is opened with the first half of its text, then
    dropped and regenerated, and the other half comes as a delta. Any other is sent as a
    draft and then edited. Events of a message are in sequence; its number is given once
    for all of them, as they are made of one row."""
    half = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    text, none = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text) - half)
    event = lambda n, kind, role, part: F.struct(F.lit(n).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), part.alias("text"))
    role = F.col("role")
    streamed = F.array(event(0, "message", role, none), event(1, "delta", none, rest), event(2, "regenerate", none, first), event(3, "delta", none, rest))
    typed = F.array(event(0, "message", role, first), event(1, "delta", none, F.lit("...")), event(2, "edit", none, text))
    numbered = rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), F.when(role == "assistant", streamed).otherwise(typed).alias("e"))
    return numbered.select("conv_id", "turn", "message", F.explode("e").alias("e")).select("conv_id", "turn", "message", "e.*")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fold the events of all conversations and conversation -1, format them, and read the output back."""
    say = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(say).alias("text"),
    )
    out = render(fold_events(event_log(rows.unionByName(extra)))).withColumn("turns", parse(F.col("formatted")))
    loss = with_loss(F.col("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = """
WITH log AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(11 + length(role) + length(
         replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')))::BIGINT AS formatted_chars
FROM log GROUP BY conv_id
"""
