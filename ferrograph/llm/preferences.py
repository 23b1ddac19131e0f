"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt; the turns after it are the
completions. A turn is rendered as <|role|>, a new line, its text, <|end|> and a new line. The mask of a completion lists the
ranges of characters to train on: the text of assistant turns with the <|end|> after it, never a header or another role's turn.

Everything runs in the JVM: one shuffle by conversation, then functions on arrays.

Defined cases: a null role counts as "unknown", a null text as empty. Turns of equal number are ordered by role and text. Equal
conversations have two empty completions; where one is a prefix of the other, one completion is empty. Such pairs, and those
that have nothing to train on in a completion, are kept with ``usable`` false. Rows of a null conversation belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Conversations with ids in one range of so many lend each other their answers.
NEIGHBOURS = 1024


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turns)``: each conversation's (role, text) in order."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    lists = turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return lists.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def lent_pairs(convs: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(chosen_id, rejected_id, chosen, rejected)``: each conversation with an answer, against itself up to its last answer with that of the next one."""
    last = F.expr("array_max(filter(transform(turns, (t, i) -> CASE WHEN t.role = 'assistant' THEN i + 1 END), i -> i IS NOT NULL))")
    answers = convs.withColumn("at", last).filter(F.col("at").isNotNull()).withColumn("answer", F.element_at("turns", F.col("at")))
    block = F.floor(F.col("conv") / neighbours)
    by = Window.partitionBy(block).orderBy("conv")
    lent = answers.withColumn("other", F.lead(F.struct("conv", "answer")).over(by))
    whole = Window.partitionBy(block).orderBy("conv").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lent = lent.withColumn("other", F.coalesce("other", F.first(F.struct("conv", "answer")).over(whole)))
    rejected = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.array("other.answer"))
    return lent.select(F.col("conv").alias("chosen_id"), F.col("other.conv").alias("rejected_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def mask(turns: Column) -> Column:
    """The ranges to train on, as start-end, with commas between."""
    head = lambda t: F.length(t["role"]) + 5
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + head(t)
        end = begin + F.length(t["text"]) + 7
        own = F.when(t["role"] == "assistant", F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(state["ranges"], own).alias("ranges"))

    return F.array_join(F.aggregate(turns, start, add)["ranges"], ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable``."""
    first_other = F.expr("array_min(filter(transform(sequence(1, least(size(chosen), size(rejected)) + 1), i -> CASE WHEN i > size(chosen) OR i > size(rejected) OR get(chosen, i - 1) != get(rejected, i - 1) THEN i END), i -> i IS NOT NULL))")
    cut = pairs.withColumn("n", first_other - 1)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    parts = cut.select("chosen_id", "rejected_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("shared"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    out = parts.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("shared")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))
