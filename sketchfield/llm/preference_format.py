"""Preference formatting: the shared prompt of two conversations, rendered once, and masked completions.

The prompt is the longest common prefix of turns (equal role and text) of the chosen and the
rejected conversation.  What follows in each is its completion, rendered alike, with a mask: the
spans of characters, of assistant turns, that a loss counts.

``last_reply_pairs`` makes pairs of a table of single conversations: chosen is the conversation,
rejected is the same with its last assistant turn replaced by that of its neighbour (the id that
differs in the lowest bit), or taken away if the neighbour has none.  A conversation without an
assistant turn has no reply to prefer: it is all prompt, and both its completions are empty.
Neighbours are gathered together, so the table is read and shuffled once.

Turns are ordered by number, then role and text; repeated rows of a turn stay.  Null roles and
texts are empty strings.  Rows with a null conversation or turn number, or a
conversation number that is no whole number, belong to none and are left out.  Equal conversations have empty completions and empty masks; a pair with one side only has the
empty conversation at the other.  An empty table gives an empty table.  Columns besides the four
are ignored.  A conversation, being one training example, is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its ordered turns, an array of (turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def last_reply_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, chosen and rejected: arrays of turns."""
    turn = F.struct(
        F.col("c").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    both = turns.withColumn("c", F.expr("try_cast(conv_id AS BIGINT)")).where("c is not null and c = conv_id and turn is not null")
    both = both.select("c", turn.alias("t")).groupBy(F.expr("shiftright(c, 1)").alias("pair")).agg(
        F.sort_array(F.collect_list("t")).alias("all"),
        F.sort_array(F.collect_set("c")).alias("ids"),
    )
    each = both.select("all", F.explode("ids").alias("conv_id"))
    of = lambda same: F.filter("all", lambda t: (t["conv_id"] == F.col("conv_id")) == same)
    each = each.select("conv_id", of(True).alias("turns"), F.filter(of(False), lambda t: t["role"] == ASSISTANT).alias("replies"))
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i)), lambda i: i.isNotNull())
    each = each.withColumn("last", F.array_max(places)).withColumn("reply", F.get(F.col("replies.text"), F.size("replies") - 1))
    replaced = F.transform(
        "turns",
        lambda t, i: F.when(F.col("last").isNull() | (i != F.col("last")), t).when(
            F.col("reply").isNotNull(),
            F.struct(t["conv_id"].alias("conv_id"), t["turn"].alias("turn"), t["role"].alias("role"), F.col("reply").alias("text")),
        ),
    )
    return each.select("conv_id", F.col("turns").alias("chosen"), F.array_compact(replaced).alias("rejected"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _one), "")


def _one(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))


def _mask(turns: Column) -> Column:
    """start:stop of the assistant's texts in the rendered turns, joined by commas."""
    start = lambda sofar, t: sofar["at"] + F.length(t["role"]) + 5
    step = lambda sofar, t: F.struct(
        (sofar["at"] + F.length(_one(t))).alias("at"),
        F.when(
            t["role"] == ASSISTANT,
            F.concat(sofar["spans"], F.array(F.concat(start(sofar, t).cast("string"), F.lit(":"), (start(sofar, t) + F.length(t["text"])).cast("string")))),
        ).otherwise(sofar["spans"]).alias("spans"),
    )
    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda end: end["spans"]), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """Of pairs (conv_id, chosen, rejected): prompt, completions and their masks."""
    empty = F.array().cast(pairs.schema["chosen"].dataType)
    c, r = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    differs = F.zip_with(c, r, lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    at = F.array_position(differs, True)
    staged = pairs.select("conv_id", c.alias("c"), r.alias("r"), F.when(at > 0, at - 1).otherwise(F.size(c)).cast("int").alias("n"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    staged = staged.select(
        "conv_id",
        F.col("n").alias("prompt_turns"),
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        rest("c").alias("c"),
        rest("r").alias("r"),
    )
    return staged.select(
        "conv_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def preference_format(turns: DataFrame) -> DataFrame:
    return formatted(last_reply_pairs(turns))
