"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put a backslash between < and | (one more where some are there), so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles also lose their line ends and backslashes, as the role ends at the first line end."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Escaped backslashes part the role into stretches in which \\n can only be a line end; so all is read in one pass and any character may stand in a role."""
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """Training examples of conversations: conv_id, example, formatted, loss_start, loss_end.

    turns: conv_id, turn, role, text.  Each turn becomes
    `<|im_start|>role\\ntext<|im_end|>\\n`; the k-th assistant turn gives an example
    of all turns up to it, with the loss mask [loss_start, loss_end) in code
    points over that turn's text alone.  Turns behind the last assistant turn
    (or all, without one) make a last example with an empty mask, so no turn is lost.

    Null texts and roles count as empty; turns with equal numbers go by role, then
    text, nulls first; repeated rows stay repeated; rows of a null conv_id are a
    conversation of their own; other columns aren't read; an empty table gives no
    rows.  A conversation's turns are gathered once; its examples are cut from
    that one string a row at a time, so the examples of a long conversation never
    stand in memory together; a conversation itself is one row, so it has to fit a task's memory a few
    times over (Spark's limit of 2 GB to a string holds too).
    """
    from pyspark.sql import Window

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    length = F.char_length("head") + F.char_length("body") + len(END) + 1
    placed = parts.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("end"),
        F.concat("head", "body", F.lit(END + "\n")).alias("shown"),
        (F.col("role") == "assistant").alias("reply"),
        F.char_length("body").alias("body_chars"),
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "end", "reply", "body_chars", "shown"))).alias("t")).select(
        "conv_id",
        F.array_join("t.shown", "").alias("full"),
        F.filter(F.transform("t", lambda x: x.dropFields("shown")), lambda x: x["reply"] | (x["place"] == F.size("t"))).alias("marks"),
    )
    one = whole.select("conv_id", "full", F.posexplode("marks").alias("example", "mark"))
    loss_end = F.col("mark.end") - len(END) - 1
    return one.select(
        "conv_id",
        "example",
        F.substring("full", F.lit(1), F.col("mark.end")).alias("formatted"),
        F.when(F.col("mark.reply"), loss_end - F.col("mark.body_chars")).otherwise(F.col("mark.end")).alias("loss_start"),
        F.when(F.col("mark.reply"), loss_end).otherwise(F.col("mark.end")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted example, in order."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    return F.transform(
        chunks,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.locate("\n", x) + 1, F.char_length(x) - F.locate("\n", x) - len(END) - 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))
