"""Chat formatting, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as one; their texts are joined by a line feed. turns: a sorted array of structs."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.array_join(F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]), "\n").alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, chat) of conversations(conv_id, turn, role, text).

    Turns are sorted by (turn, role, text), null turns first, so ties and repeated rows have one order; all are kept. A null role
    is "unknown", a null text empty; rows with a null conv_id make one conversation. Other columns aren't read. A conversation
    is one row of the aggregate, so it must fit in memory, as its text must in any case.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), merged(F.col("turns")).alias("messages"))
    one = F.transform("messages", lambda m: F.concat(F.lit(BEGIN), m["role"], F.lit("\n"), m["text"], F.lit(f"{END}\n")))
    return chats.select("conv_id", "n_turns", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(one, "").alias("chat"))
