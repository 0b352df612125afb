r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have the same role, and
concatenated into one string with a loss mask over the assistant's texts. Texts are escaped so that no control
string of the template can occur in them: `\` becomes `\b` and `<` becomes `\l`; a role's `>` becomes `\g`.
Every backslash in an escaped text is thus followed by one letter, and plain replacement undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template, fixed values.
OPEN, MID, NEXT, CLOSE = "<turn:", ">", "<next>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\g"), F.lit(">")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to one row a conversation: conv_id, formatted, loss_mask.

    loss_mask lists the (start, length) of each text of `loss_role` in `formatted`, in code points. Null role or
    text counts as empty. Turns are sorted by (turn, role, text), null turns first, so ties and repeated rows have
    one order and are all kept. Rows of a null conv_id form one conversation. Other columns are ignored. A
    conversation is one output row, so it must fit in a row.
    """
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # A turn opens a block if its role differs from that of the turn before it; inside a block texts are joined.
    n = F.size("t")
    piece = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.when((i > 1) & (F.get("t", i - 2)["role"] == F.get("t", i - 1)["role"]), F.lit(NEXT))
            .otherwise(F.concat(F.lit(OPEN), escape_role(F.get("t", i - 1)["role"]), F.lit(MID)))
            .alias("head"),
            escape(F.get("t", i - 1)["text"]).alias("body"),
            F.when((i < n) & (F.get("t", i)["role"] == F.get("t", i - 1)["role"]), F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
            (F.get("t", i - 1)["role"] == loss_role).alias("loss"),
        ),
    )
    p = g.select("conv_id", piece.alias("p"))
    p = p.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform("p", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), F.length(x["tail"]).alias("t"), x["loss"].alias("loss"))).alias("p"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    mask = F.aggregate(
        "p",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["b"] + x["t"]).cast("long").alias("at"),
            F.when(
                x["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["h"]).cast("long").alias("start"), x["b"].cast("long").alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return p.select("conv_id", "formatted", mask.alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """What `formatted` says: turns as array<struct<role, text>>, and the text under the mask, both unescaped."""
    blocks = F.split("formatted", "</turn>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # the last piece is empty
    # A block is OPEN role MID text (NEXT text)*; the role has no MID, so the first one ends it.
    role = lambda b: unescape_role(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MID, 1))
    body = lambda b: F.substr(b, F.instr(b, MID) + 1)
    turns = F.flatten(
        F.transform(blocks, lambda b: F.transform(F.split(body(b), NEXT), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text"))))
    )
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
