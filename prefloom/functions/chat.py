"""Chat messages: ARRAY<STRUCT<role, content>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shared_messages(chosen: Column, rejected: Column) -> Column:
    """How many messages two conversations have in common from their start."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(chosen), F.size(rejected)))


def extract_prompt(chosen: Column, rejected: Column) -> Column:
    """struct(prompt, chosen, rejected): the common start, and what follows it in either conversation."""
    n = shared_messages(chosen, rejected).cast("int")
    rest = lambda m: F.slice(m, n + 1, F.greatest(F.size(m) - n, F.lit(0)))
    return F.struct(F.slice(chosen, F.lit(1), n).alias("prompt"), rest(chosen).alias("chosen"), rest(rejected).alias("rejected"))


def apply_chat_template(messages: Column, eos: str, add_generation_prompt: bool = False) -> Column:
    """Render messages: the end mark, then each turn under its role's mark; an assistant's turn ends with the end mark.

    Messages of other roles leave only their line breaks, as the template's control lines do.
    """
    n = F.size(messages)
    gap = F.lit("\\n")  # the template file holds these two characters between its control lines

    def turn(m: Column, i: Column) -> Column:
        user = F.concat(gap, F.lit("<|user|>\n"), m["content"], gap)
        assistant = F.concat(gap, F.lit("<|assistant|>\n"), m["content"], F.lit(eos), gap)
        body = F.when(m["role"] == "user", user).when(m["role"] == "assistant", assistant).otherwise(F.lit(""))
        last = F.concat(gap, F.lit("<|assistant|>"), gap) if add_generation_prompt else F.lit("")
        return F.concat(gap, body, gap, F.when(i == n - 1, last).otherwise(F.lit("")), gap)

    return F.concat(F.lit(eos), F.array_join(F.transform(messages, turn), ""))
