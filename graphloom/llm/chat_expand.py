"""Prefix-target expansion of conversations, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
text trainable. Turns are marked by a template; in texts and roles the characters that any control
string would need are escaped, so no text can forge a mark, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: <|role|>text<|end|> for each turn.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Escaped characters; "%" starts an escape, so it is first in and last out. "|" can only disturb a role.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))
BAR = ("|", "%7C")
ASSISTANT = "assistant"
#: Who says what in the fixed conversation that the query adds.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: F.Column) -> F.Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: F.Column) -> F.Column:
    for plain, coded in (BAR, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (from 0), n_turns, text, loss_start, loss_end (code points, end exclusive), last.

    Turns are taken in order of turn, then role, then text; a null turn sorts first, a null role or
    text is empty, and null ids form a conversation of their own. Repeated rows are repeated turns.
    Turns after the last assistant turn go out in a closing example with nothing to train on (null
    loss), so that no turn is lost; ``last`` marks the example that holds the whole conversation. An
    empty table gives an empty result. One conversation is one group, and its examples are prefixes
    of it, so their length grows with the square of its turns: that is what the expansion asks for.
    """
    column = lambda c: F.col(f"`{c}`")
    turns = conversations.select(
        column(conv).alias("conv_id"),
        F.struct(column(turn).alias("turn"), F.coalesce(column(role).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(BAR[0]), F.lit(BAR[1])), F.lit(CLOSE))
    marked = ordered.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("marked"),
        F.transform("turns", lambda t: F.when(t["role"] == ASSISTANT, F.struct(F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body")))).alias("targets"),
    )
    size = F.size("marked")
    places = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("targets", i).isNotNull() | (i == size))
    exploded = marked.select("conv_id", "marked", "targets", F.posexplode(places).alias("example", "n_turns"))
    target = F.element_at("targets", F.col("n_turns"))
    before = F.array_join(F.slice("marked", F.lit(1), F.col("n_turns") - 1), "")
    examples = exploded.select("conv_id", "example", "n_turns", before.alias("before"), F.element_at("marked", F.col("n_turns")).alias("own"), target.alias("target"), (F.col("n_turns") == size).alias("last"))
    start = F.length("before") + F.col("target.head")
    return examples.select("conv_id", "example", "n_turns", F.concat("before", "own").alias("text"), start.alias("loss_start"), (start + F.col("target.body")).alias("loss_end"), "last")


def read_turns(text: F.Column) -> F.Column:
    """Turns (role, text) of a formatted text."""
    pieces = F.split(text, r"<\|end\|>", -1)

    def turn(piece: F.Column) -> F.Column:
        role = F.substring_index(F.substr(piece, F.lit(3)), CLOSE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(role) + 5)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    examples = expand(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe))
    learned = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    held = examples.select(
        "conv_id",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", learned.alias("text"))).alias("loss"),
    )
    by_conversation = held.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("loss")).alias("losses"))
    loss = F.array_join(F.col("losses.text"), "")
    turns = by_conversation.select("conv_id", "formatted_chars", loss.alias("loss"), read_turns(F.col("whole")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
