"""Chat turns: where answers go, examples before them, and rounds of a model over all conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_responding_turn(messages: Column) -> Column:
    """Index of the first message that isn't from the system or the developer; the number of messages without one."""
    at = F.array_position(F.transform(messages, lambda m: ~m["role"].isin("system", "developer")), True)
    return F.when(at > 0, at - 1).otherwise(F.size(messages)).cast("int")


def next_response_slot(messages: Column) -> Column:
    """Where the next assistant message belongs: after the first user or tool message that none follows; null if there is none."""
    n = F.size(messages)
    asks = F.transform(messages, lambda m, i: m["role"].isin("user", "tool") & ~F.coalesce(F.try_element_at(messages, (i + 2).cast("int"))["role"] == "assistant", F.lit(False)))
    at = F.array_position(asks, True)
    return F.when((n > 0) & (at > 0), at).cast("int")


def turn_slots(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conversation, slot``: the same over rows of turns, with the turn number after which the answer belongs; null without one."""
    after = F.lead("role").over(Window.partitionBy(conversation).orderBy(turn))
    open_ = F.when(F.col("role").isin("user", "tool") & ~F.coalesce(F.col("_after") == "assistant", F.lit(False)), F.col(turn) + 1)
    return turns.withColumn("_after", after).groupBy(conversation).agg(F.min(open_).alias("slot"))


def insert_examples(messages: Column, shots: Column) -> Column:
    """``messages`` with the messages of ``shots``, an array of arrays, before the first responding turn."""
    at = first_responding_turn(messages)
    return F.concat(F.slice(messages, F.lit(1), at), F.flatten(shots), F.slice(messages, at + 1, F.size(messages)))


def plain_messages(messages: Column) -> Column:
    """Messages without what only the engine needs."""
    return F.transform(messages, lambda m: m.dropFields("finish_reason", "raw_content", "tool_call_validation_result"))


def split_last_answer(messages: Column) -> tuple[Column, Column]:
    """(messages without a trailing assistant turn, references of that turn)."""
    last = F.try_element_at(messages, F.lit(-1))
    answer = F.coalesce(last["role"] == "assistant", F.lit(False))
    return F.when(answer, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages), F.when(answer, F.array(last["content"])).otherwise(F.array().cast("array<string>"))


def rounds(conversations: DataFrame, generate: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Conversations ``row_id, messages`` with an answer in every slot: a pass of ``generate`` (adds ``answer``) a turn over those that still have one; ``cut`` writes each pass to the shared folder."""
    done, open_ = [], conversations
    while True:  # each pass fills a slot of every open conversation
        slotted = open_.withColumn("_slot", next_response_slot(F.col("messages")))
        done.append(slotted.where("_slot IS NULL").drop("_slot"))
        open_ = slotted.where("_slot IS NOT NULL")
        if open_.isEmpty():
            break
        context = open_.withColumns({"_all": F.col("messages"), "messages": F.slice("messages", F.lit(1), F.col("_slot"))})
        said = F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
        merged = F.concat("messages", said, F.slice("_all", F.col("_slot") + 1, F.greatest(F.size("_all") - F.col("_slot"), F.lit(0))))
        open_ = cut(generate(context).withColumn("messages", merged).drop("_all", "_slot", "answer"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
