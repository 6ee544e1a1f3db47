"""Chat formatting with Spark expressions: turns sorted, merged by role, escaped and concatenated."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The control strings of the default template.
OPEN, TEXT, END_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


@dataclass(frozen=True)
class Template:
    """A block holds adjacent turns of one role: open, role, then each text between its marks, close."""

    open: str = OPEN
    text: str = TEXT
    end_text: str = END_TEXT
    close: str = CLOSE

    @property
    def marks(self) -> list[str]:
        return [self.open, self.text, self.end_text, self.close]

    def escape(self, text: Column) -> Column:
        """Double every backslash, then put one behind the first character of each control string."""
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for mark in self.marks:
            out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _check(template: Template) -> None:
    if len(set(template.marks)) < 4 or any(len(m) < 2 or "\\" in m for m in template.marks):
        raise ValueError("four different marks of two or more characters without a backslash are needed")


def format_chats(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant",
                 conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` text and ``loss`` spans (start from 0, length, in code points).

    Turns go by turn (null first), then role and text, so ties have one order; repeated rows
    stay. Null role or text counts as empty; a null id is a conversation of its own; other
    columns are not read. Adjacent turns of one role share a block but keep their own text
    marks, so the output can be read back exactly. An empty table gives no rows.
    """
    _check(template)
    rows = turns.select(F.col(conversation).alias("id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                      lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    runs = sorted_turns.withColumn("starts", starts)
    # Adjacent turns of one role become one block; each piece is (text to write, whether its text bears loss).
    blocks = F.transform("starts", lambda s, j: F.struct(
        F.get("turns", s)["role"].alias("role"),
        F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s).alias("own")))
    merged = runs.select("id", blocks.alias("blocks"))
    piece = lambda x, loss: F.struct(x.alias("x"), loss.alias("loss"))
    never = F.lit(False)
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(piece(F.concat(F.lit(template.open), template.escape(b["role"])), never)),
        F.flatten(F.transform(b["own"], lambda t: F.array(
            piece(F.lit(template.text), never), piece(template.escape(t["text"]), b["role"] == loss_role), piece(F.lit(template.end_text), never)))),
        F.array(piece(F.lit(template.close), never)))))
    flat = merged.select("id", pieces.alias("pieces"))
    flat = flat.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["x"])))
    # Running start of each piece, then the spans that bear loss.
    walked = F.aggregate(
        F.arrays_zip("sizes", F.transform("pieces", lambda p: p["loss"]).alias("bears")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, z: F.struct((a["at"] + z["sizes"]).alias("at"),
                              F.when(z["bears"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), z["sizes"].alias("length")))))
                              .otherwise(a["spans"]).alias("spans")))
    return flat.select(F.col("id").alias(conversation), F.array_join(F.transform("pieces", lambda p: p["x"]), "").alias("formatted"),
                       walked["spans"].alias("loss"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_text`` read from the output string and its spans."""
    quoted = lambda x: re.escape(x)
    blocks = F.filter(F.split("formatted", quoted(template.close)), lambda b: b.startswith(template.open))
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(len(template.open) + 1), F.length(b)), quoted(template.text)))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(
        F.slice(p, F.lit(2), F.size(p)),
        lambda t: F.struct(template.unescape(p[0]).alias("role"),
                           template.unescape(F.substring(t, F.lit(1), F.length(t) - len(template.end_text))).alias("text")))))
    loss = F.array_join(F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
