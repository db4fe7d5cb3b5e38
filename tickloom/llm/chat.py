"""Chat formatting in Spark expressions: one row per turn in, one formatted conversation per row out.

Turns are collected as structs and sorted; adjacent turns of one role become one block, whose texts are joined by a
mark of their own, so that the turns can be told apart again:

    <|im_start|>ROLE\\nTEXT<|im_next|>TEXT<|im_end|>\\n

Every control string, ours or another template's, starts with `<` or `[`. Texts and roles are escaped (& < [ become
entities, in roles the line feed too), so none can occur inside them, and unescaping gives the exact text back.

The loss mask has one (start, length) per turn, counted in code points from the mark that opens the turn; its length
is 0 where the role is not trained on.

Defined cases: null texts and roles are empty; turns that tie are ordered by role, then text; repeated rows are turns
each; a null conversation id is a conversation of its own; an empty table gives no rows; other columns are ignored.
A conversation is one document and must fit in a row; the work per conversation is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
SEGMENT = r"(?=<\|im_(?:start|next)\|>)"


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    for a, b in (("\n", "&#10;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): each conversation's text and the turns to train on."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&#10;")).alias("name"), escaped(t["text"]).alias("text"))))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    opens = F.filter(at, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    convs = convs.withColumn("opens", opens)
    texts = F.transform("opens", lambda i, k: F.slice("turns", i + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - i))
    block = F.transform(texts, lambda run: F.concat(
        F.lit(START), F.get(run, F.lit(0))["name"], F.lit("\n"), F.array_join(F.transform(run, lambda t: t["text"]), NEXT), F.lit(END)))
    head = F.transform(texts, lambda run: F.transform(run, lambda t, i: F.struct(
        F.when(i == 0, F.char_length(t["name"]) + len(START) + 2).otherwise(len(NEXT) + 1).alias("start"),
        F.when(t["role"] == trained, F.char_length(t["text"])).otherwise(0).alias("length"))))
    return convs.select("conv_id", F.array_join(block, "").alias("formatted"), F.flatten(head).alias("mask"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: _turns_of(b)))


def _turns_of(block: Column) -> Column:
    head = F.substring_index(block, "\n", 1)
    body = F.substr(block, F.char_length(head) + 2)
    return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(
        unescaped(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescaped(t).alias("text")))


def read_trained(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    parts = F.filter(F.split(text, SEGMENT), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s, i: unescaped(F.substr(s, F.get(mask, i)["start"], F.get(mask, i)["length"]))), "")
