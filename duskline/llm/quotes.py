"""Conversations in reply order, with quotations turned into links.

A line that begins with quote marks belongs to a quotation, of the level that the
marks count. The lines of a level are one quotation; its sentences, normalised and
hashed, are its passages. They are joined to the messages that say them: in the
same conversation, or else in any conversation that comes before. The message that holds most of the quotation by length is the one it answers. Messages
that quote another conversation move into its thread, behind what they answer, and
take along those that answer them.

Only DataFrame functions are used. A passage that many say is never joined with all of
them; see ``candidates``.

Defined cases: a null text is empty and a null role is ``unknown``; a message of
quotations only has an empty text; a message whose quotations match nothing, or
nothing before it, has no parent; rows with a null ``conv_id`` or ``turn`` stay, link
with nothing and come first; repeated rows stay; equal matches go to the earliest
message; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.llm.common import dropped, saved, splittable

MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
ATTRIBUTION = r"(?i)^.{0,200}\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
# Passages with more sayers go by the sets of them that messages hold, with equal results.
FEW = 8
SENTENCE_END = r"(?<=[.!?…])\s+"


def quote_level(line: Column) -> Column:
    """Number of quote marks before the text of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def parsed_lines(text: Column) -> Column:
    """``array<struct<level int, text string, attribution boolean>>`` of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return F.transform(
        lines,
        lambda line: F.struct(
            quote_level(line).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("text"),
            line.rlike(ATTRIBUTION).alias("attribution"),
        ),
    )


def own_text(lines: Column) -> Column:
    """What the author wrote: lines without marks, and without who-wrote-it lines before a quotation."""
    kept = F.filter(
        lines,
        lambda line, i: (line["level"] == 0)
        & ~(line["attribution"] & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    joined = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return F.trim(F.regexp_replace(joined, r"^\s+|\s+$", ""))


def passages(text: Column) -> Column:
    """Distinct ``struct<hash bigint, size int>`` of a text's normalised sentences."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    sentences = F.filter(F.split(plain, SENTENCE_END), lambda s: s != "")
    return F.array_distinct(
        F.transform(sentences, lambda s: F.struct(F.xxhash64(s).alias("hash"), F.length(s).alias("size")))
    )


def parsed_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (without quotations), ``lines``, ``levels``."""
    lines = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        parsed_lines(F.col("text")).alias("lines"),
    )
    levels = F.array_max(F.transform("lines", lambda line: line["level"]))
    text = own_text(F.col("lines")).alias("text")
    return lines.select("conv_id", "turn", "role", text, "lines", levels.alias("levels"))


def quotation_links(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_conv_id, parent_turn`` of every message that answers another.

    The quotation of the lowest level that matches decides.
    """
    known = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    said = known.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).select(
        "conv_id", "turn", F.col("p.hash").alias("hash")
    )
    level = F.explode(F.sequence(F.lit(1), F.col("levels"))).alias("level")
    quoted = known.where(F.col("levels") > 0).select("conv_id", "turn", "lines", level)
    whole = F.array_join(
        F.transform(F.filter("lines", lambda x: x["level"] == F.col("level")), lambda x: x["text"]), " "
    )
    quoted = (
        quoted.select("conv_id", "turn", "level", F.explode(passages(whole)).alias("p"))
        .select("conv_id", "turn", "level", F.col("p.hash").alias("hash"), F.col("p.size").alias("size"))
        .distinct()
    )
    quoted = saved(quoted, "quoted")
    wanted = splittable(quoted.select("hash").distinct())
    said = saved(said.distinct().join(wanted, "hash", "left_semi").select("conv_id", "turn", "hash"), "said")
    found = candidates(quoted, said).join(quoted, ["conv_id", "turn", "level"])
    holders = said.select(
        F.col("conv_id").alias("parent_conv_id"), F.col("turn").alias("parent_turn"), "hash"
    )
    names = ["conv_id", "turn", "level", "parent_conv_id", "parent_turn"]
    votes = (
        found.join(splittable(holders), ["parent_conv_id", "parent_turn", "hash"])
        .groupBy(names)
        .agg(F.sum("size").alias("size"))
    )
    # Own conversation first, then the lowest level, the most text, the earliest message.
    rank = F.struct(
        (F.col("parent_conv_id") != F.col("conv_id")).alias("away"),
        "level",
        (-F.col("size")).alias("less"),
        "parent_conv_id",
        "parent_turn",
    )
    best = votes.groupBy("conv_id", "turn").agg(F.min(rank).alias("best"))
    return best.select(
        "conv_id", "turn",
        F.col("best.parent_conv_id").alias("parent_conv_id"),
        F.col("best.parent_turn").alias("parent_turn"),
    )


def candidates(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``conv_id, turn, level, parent_conv_id, parent_turn``: messages before a quotation, the best among them.

    A passage counts once within its conversation and once among all. One that few say
    leads to all who say it. Of the messages that share only common passages with a
    quotation, those that hold the same ones are one row, their earliest; of these rows
    only those stay that hold more than every earlier one. What else a candidate
    holds can only raise it, so no message that wins is left out.
    """

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        inside = rows.select(
            F.lit(False).alias("away"), F.xxhash64("conv_id", "hash").alias("key"), "conv_id", "turn", *more
        )
        return inside.unionByName(
            rows.select(F.lit(True).alias("away"), F.col("hash").alias("key"), "conv_id", "turn", *more)
        )

    def sets(rows: DataFrame, passage: Column, *names: str) -> DataFrame:
        return rows.groupBy("away", *names).agg(F.sort_array(F.collect_set(passage)).alias("held"))

    before = F.when(F.col("away"), F.col("parent_conv_id") < F.col("conv_id")).otherwise(
        (F.col("parent_conv_id") == F.col("conv_id")) & (F.col("parent_turn") < F.col("turn"))
    )
    names = ["conv_id", "turn", "level", "parent_conv_id", "parent_turn"]
    asked, sayers = keyed(quoted, "level", "size"), keyed(said)
    counts = saved(sayers.groupBy("away", "key").agg((F.count(F.lit(1)) > FEW).alias("common")), "sayers")
    keys = ["away", "key"]
    few = splittable(counts.where(~F.col("common")).select(keys))
    common = splittable(counts.where("common").select(keys))

    parents = sayers.select(
        *keys, F.col("conv_id").alias("parent_conv_id"), F.col("turn").alias("parent_turn")
    )
    rare = asked.join(splittable(parents.join(few, keys, "left_semi")), keys).where(before).select(names)

    holders = (
        sets(sayers.join(common, keys, "left_semi"), F.col("key"), "conv_id", "turn")
        .groupBy("away", "held")
        .agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    )
    sized = F.struct("key", "size")
    of_quotation = sets(asked.join(common, keys, "left_semi"), sized, "conv_id", "turn", "level")
    of_quotation = saved(of_quotation.withColumn("set", F.sha2(F.to_json("held"), 256)), "common")
    distinct = of_quotation.groupBy("away", "set").agg(F.first("held").alias("held"))
    parts = distinct.select("away", "set", F.explode("held").alias("p")).select(
        "away", "set", F.col("p.key").alias("key"), F.col("p.size").alias("size")
    )
    held = holders.select("away", "first", F.explode("held").alias("key"))
    shared = (
        parts.join(splittable(held), keys)
        .groupBy("away", "set", "first")
        .agg(F.sum("size").alias("shared"))
    )
    earlier = Window.partitionBy("away", "set").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    best = shared.withColumn("most", F.max("shared").over(earlier)).where(
        F.col("most").isNull() | (F.col("shared") > F.col("most"))
    )
    best = best.select(
        "away", "set", F.col("first.conv_id").alias("parent_conv_id"), F.col("first.turn").alias("parent_turn")
    )
    frequent = of_quotation.join(splittable(best), ["away", "set"]).where(before).select(names)
    return rare.unionByName(frequent).distinct()


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, thread`` of messages that answer another.

    The thread is the conversation of the first message of the chain, so a message goes
    with the one it answers also inside its own conversation. Pointers are doubled until
    none leads further. A parent comes before its child in ``conv_id`` and ``turn``, so
    there is no circle.
    """
    at = saved(
        links.select(
            "conv_id",
            "turn",
            F.col("parent_conv_id").alias("to_conv"),
            F.col("parent_turn").alias("to_turn"),
        ),
        "threads",
    )
    while True:
        further = at.select(
            F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"),
            F.col("to_conv").alias("next_conv"), F.col("to_turn").alias("next_turn"),
        )
        joined = at.join(further, ["to_conv", "to_turn"], "left")
        if joined.where(F.col("next_conv").isNotNull()).isEmpty():
            return at.select("conv_id", "turn", F.col("to_conv").alias("thread"))
        again = saved(
            joined.select(
                "conv_id", "turn",
                F.coalesce("next_conv", "to_conv").alias("to_conv"),
                F.coalesce("next_turn", "to_turn").alias("to_turn"),
            ),
            "threads",
        )
        dropped(at)
        at = again


def conversations_in_reply_order(messages: DataFrame, template: str = "<|%s|>\n%s\n<|end|>\n") -> DataFrame:
    """A row per message, in the order of threads and replies.

    Columns: ``thread``, ``conv_id``, ``turn``, ``role``, ``text`` without quotations,
    ``quote_levels``, ``parent_conv_id``, ``parent_turn``, and ``formatted``, the
    message in the chat template. The rows are sorted by ranges of thread,
    conversation and turn, so a long conversation is split over tasks.
    """
    parsed = parsed_messages(messages)
    links = saved(quotation_links(parsed), "links")
    at = threads(links)
    own = parsed.select("conv_id", "turn", "role", "text", F.col("levels").alias("quote_levels"))
    joined = own.join(links, ["conv_id", "turn"], "left").join(at, ["conv_id", "turn"], "left")
    rows = joined.select(
        F.coalesce("thread", "conv_id").alias("thread"),
        "conv_id", "turn", "role", "text", "quote_levels", "parent_conv_id", "parent_turn",
        F.format_string(template, "role", "text").alias("formatted"),
    )
    return rows.orderBy("thread", "conv_id", "turn", F.xxhash64("role", "text"))
