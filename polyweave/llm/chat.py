"""Chats: quotations are linked to the messages they come from, and taken out of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

#: turns of a conversation that are looked through together for the origin of a passage
BLOCK = 4096


def lines_of(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with ``lines``: array of (level, passage, hash), one for each line with text.

    The level is the number of leading '>' marks, with or without spaces between them.  For the
    hash a passage is lower-cased and everything but letters and digits becomes one space; a
    passage without letters and digits has no hash and is no quotation of anything.
    """
    marks = r"^\s*((>\s?)+)"
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")

    def line(s):
        lead = F.regexp_extract(s, marks, 1)
        said = F.regexp_replace(s, marks, "")
        norm = F.trim(F.regexp_replace(F.lower(said), r"[^\p{L}\p{N}]+", " "))
        return F.struct((F.length(lead) - F.length(F.translate(lead, ">", ""))).alias("level"), said.alias("passage"),
                        F.when(norm != "", F.xxhash64(norm)).alias("hash"))

    return messages.withColumn("lines", F.transform(split, line))


def _origins(marked: DataFrame) -> DataFrame:
    """``(row, level, origin)``: for each quoted line the latest earlier turn that wrote it itself.

    Lines are ordered by turn within (conversation, passage); a quotation looks back to the last
    own line.  A passage that is very common in a long conversation is cut into blocks of turns,
    and only the last own turn of each block goes on to the next ones.
    """
    each = (marked.where("conv_id is not null and turn is not null").select("conv_id", "turn", "row", F.explode("lines").alias("x"))
            .select("conv_id", "turn", "row", F.col("x.level").alias("level"), F.col("x.hash").alias("hash")).where("hash is not null"))
    quoted = each.where("level > 0").select("conv_id", "hash").distinct()
    each = each.join(quoted, ["conv_id", "hash"], "left_semi").withColumn("block", F.floor(F.col("turn") / BLOCK))
    events = each.groupBy("conv_id", "hash", "block", "turn", "row", "level").agg(F.count(F.lit(1)).alias("n"))
    key = ["conv_id", "hash"]
    own = F.when(F.col("level") == 0, F.col("turn"))
    last = events.groupBy(*key, "block").agg(F.max(own).alias("own"))
    carry = last.select(*key, "block", F.max("own").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("here", F.max(own).over(before)).where("level > 0")
    return found.join(carry, [*key, "block"]).select("row", "level", "n", F.coalesce("here", "carried").alias("origin"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message, without quotations, linked to the message it replies to.

    ``(conv_id, turn, role, text, n_quotes, n_linked, parent_turn, depth, thread_turn)``:
    ``text`` is the message without quoted lines; ``n_quotes`` are its quoted lines and
    ``n_linked`` those found among the own lines of earlier turns of the conversation.  The
    parent is the turn that most of the innermost-first level's linked lines come from, the
    latest one if several do, and nested quotes only count where no outer one is linked.
    Following parents leads to ``thread_turn`` in ``depth`` steps; ordering a conversation by
    (thread_turn, turn) gives every reply a place after what it answers.  Messages without
    linked quotes begin a thread.  Null texts are empty; rows without a conv_id or turn keep
    their text and are linked to nothing; of rows that repeat a turn each is answered alike.
    Other columns are ignored.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    marked = settle(lines_of(rows).withColumn("row", F.monotonically_increasing_id()))
    origins = settle(_origins(marked))
    votes = (origins.where("origin is not null").groupBy("row", "level", "origin").agg(F.sum("n").alias("n"))
             .groupBy("row").agg(F.min(F.struct("level", -F.col("n"), -F.col("origin"), "origin"))["origin"].alias("parent_turn")))
    counts = origins.groupBy("row").agg(F.sum(F.when(F.col("origin").isNotNull(), F.col("n"))).alias("n_linked"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    out = (marked.join(votes, "row", "left").join(counts, "row", "left")
           .select("row", "conv_id", "turn", "role", F.trim(F.array_join(F.transform(own, lambda x: x["passage"]), "\n")).alias("text"),
                   F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
                   F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn"))
    out = settle(out)
    # jump along parents, twice as far each round; only replies take part
    steps = settle(out.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("to")).withColumn("far", F.lit(1).cast("long")))
    open_steps = None
    while True:
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        steps = settle(steps.join(ahead, ["conv_id", "to"], "left")
                       .select("conv_id", "turn", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        now = steps.agg(F.count(F.lit(1)), F.sum("far"), F.sum("to")).first()
        if now == open_steps:
            break
        open_steps = now
    return out.join(steps, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_turn", F.coalesce("far", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("to", "turn").alias("thread_turn"))
