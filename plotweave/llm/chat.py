"""Chat formatting: one training example per assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    r"""Backslashes doubled, then ``<|`` written ``<\|``: no control string is left.

    Every backslash of the text comes out in a run of even length, so the single one between
    ``<`` and ``|`` cannot be mistaken.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As :func:`escape`; a newline, which ends the role, is written ``<\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _header(role: Column) -> Column:
    return F.concat(F.lit(TURN_START), escape_role(role), F.lit("\n"))


def prefix_target_examples(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                           role: str = "role", text: str = "text") -> DataFrame:
    """Every assistant turn as an example of its own, all turns before it as context.

    Returns conv_id, example (from 1), n_examples, text (the formatted turns up to the target),
    n_turns in it, and the span [loss_start, loss_end) of the target in code points: only that
    reply is trained on. A conversation that does not end with an assistant turn has one more
    row, with its whole text and an empty span, so that every turn can be read back.

    Turns are ordered by turn, then role and text (null first). Null role and text are empty;
    rows with a null conversation form one of their own; repeated rows are repeated turns. An
    empty table gives an empty one. Other columns take no part, whatever their names.

    A conversation is gathered in one row: an example is one string, and its size is the limit.
    Rows meet by conversation in one shuffle of the plain turns; the examples, whose size grows
    with the square of a conversation's length, are made after it and not shuffled.
    """
    plain = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    gathered = plain.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(_header(t["role"]), escape(t["text"]), F.lit(TURN_END)).alias("text"),
        F.length(_header(t["role"])).alias("header"),
        F.length(escape(t["text"])).alias("body"),
        (t["role"] == ASSISTANT).alias("trained")))
    shaped = gathered.select("conv_id", parts.alias("parts"))
    places = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (
        F.element_at("parts", i)["trained"] | (i == F.size("parts"))))
    one = shaped.select(
        "conv_id", "parts", F.size(places).alias("n_examples"),
        F.posexplode(places).alias("example", "n_turns"))
    shown = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("n_turns")),
                                     lambda p: p["text"]), "")
    target = F.element_at("parts", F.col("n_turns"))
    tail = F.length(F.lit(TURN_END))
    made = one.select(
        "conv_id", (F.col("example") + 1).alias("example"), "n_examples", "n_turns",
        shown.alias("text"), target["trained"].alias("trained"), target["body"].alias("body"))
    end = F.length("text") - tail
    return made.select(
        "conv_id", "example", "n_examples", "n_turns", "text",
        F.when(F.col("trained"), end - F.col("body")).otherwise(end).alias("loss_start"),
        end.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(TURN_START) + 1))
        at = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substr(inner, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substr(inner, at + 1)).alias("text"))

    return F.transform(whole, turn)


def masked_text(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """What is trained on, unescaped."""
    return unescape(F.substr(text, loss_start + 1, loss_end - loss_start))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: sizes and digests of turns and targets.

    Only the last example of a conversation holds all its turns; of the others the shuffle
    carries the target and the size.
    """
    last = F.col("example") == F.col("n_examples")
    turns = read_turns(F.col("text"))
    listed = F.array_join(F.transform(turns, lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example",
        F.when(last, F.size(turns)).alias("n_turns"),
        F.when(last, F.sha2(listed, 256)).alias("turns_sha256"),
        masked_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("target"),
        F.length("text").alias("chars"))
    return read.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "target"))),
                                 lambda e: e["target"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
