"""Conversations in reply order from quoted messages, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.llm.common import lower_ascii, pick
from newsmill.session import durable

MARKS = r"^(?:[ \t]*>)+"


def _normalised(text: Column) -> Column:
    """A-Z in lower case, runs of blanks as one space, no blank ends."""
    return F.btrim(F.regexp_replace(lower_ascii(text), r"[ \t\r\n\x0b\x0c]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, message, level, first, text, hash): runs of lines at one quote level,
    parted by blank lines; first is the run's first line.  ``messages`` has conv, turn,
    message (a key of the row) and text."""
    lines = messages.select(
        "conv", "turn", "message", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).select(
        "conv", "turn", "message", "pos",
        (F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))).alias("level"),
        F.regexp_replace("line", MARKS + "[ \t]?", "").alias("line"),
    )
    within = Window.partitionBy("conv", "turn", "message").orderBy("pos")
    blank = _normalised(F.col("line")) == ""
    before = F.lag("level").over(within)
    new = before.isNull() | (before != F.col("level")) | F.lag(blank).over(within)
    return (
        lines.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(within))
        .where(~blank)
        .groupBy("conv", "turn", "message", "run", "level")
        .agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
        .withColumn("text", F.array_join(F.col("lines.line"), "\n"))
        .select("conv", "turn", "message", "level", "first", "text", F.md5(_normalised(F.col("text"))).alias("hash"))
    )


def quote_links(found: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, quoted_turn): each quoted passage with the first message of its
    conversation that has the passage as its own words, if that came before.

    First places are aggregated before the shuffle, so a passage that thousands of messages
    share is one row on that side."""
    own = found.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("quoted_turn"))
    return (
        found.where("level > 0")
        .select("conv", "turn", "level", "hash")
        .join(durable(own, "own"), ["conv", "hash"])
        .where("quoted_turn < turn")
    )


def _climb(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent_turn, root_turn, depth) by pointer doubling.

    A round doubles how far up the open turns look; turns that see their root are done and
    only looked up from then on."""
    names = ["conv", "turn", "parent_turn"]
    done = parents.where("parent_turn is null").select(*names, F.col("turn").alias("root_turn"), F.lit(0).alias("depth"))
    going = durable(
        parents.where("parent_turn is not null").select(*names, F.col("parent_turn").alias("at"), F.lit(1).alias("steps")),
        "climb",
    )
    while not going.isEmpty():
        above = done.select(
            "conv", F.col("turn").alias("at"), F.col("root_turn").alias("_at"), F.col("depth").alias("_steps"), F.lit(True).alias("_end")
        ).unionByName(
            going.select(
                "conv", F.col("turn").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.lit(False).alias("_end")
            )
        )
        moved = durable(
            going.join(above, ["conv", "at"]).select(
                *names, F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), "_end"
            ),
            "climb",
        )
        done = done.unionByName(
            moved.where("_end").select(*names, F.col("at").alias("root_turn"), F.col("steps").alias("depth"))
        )
        going = moved.where("not _end").drop("_end")
    return done


def reply_order(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per message: conv_id, turn, role, text (its own words), n_quotes (passages quoted),
    deepest (the highest quote level), parent_turn, root_turn and depth.

    Quote levels are the ``>`` marks before a line.  A passage is a run of lines at one level; it
    is hashed with A-Z lower-cased and blanks folded, and belongs to the first message of the
    conversation with that passage of its own.  A message replies to the latest message that it
    quotes at level 1; one that quotes nothing known is a root.  Ordered by conv_id, root_turn,
    depth and turn, every message follows what it replies to.  Own passages are joined by one
    blank line.

    A null text is empty.  Messages without conv_id or turn are not linked.  Rows with the same conv_id
    and turn share parent, root and depth.  A conversation of any size stays rows: nothing
    gathers it.
    """
    messages = durable(
        pick(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("message", F.xxhash64("role", "text")),
        "messages",
    )
    found = durable(passages(messages.select("conv", "turn", "message", "text").distinct()), "passages")
    linked = quote_links(found).where("level = 1").groupBy("conv", "turn").agg(F.max("quoted_turn").alias("parent_turn"))
    turns = messages.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    tree = _climb(durable(turns.join(linked, ["conv", "turn"], "left"), "turns"))
    words = found.groupBy("conv", "turn", "message").agg(
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("first", "text")))).alias("own"),
        F.count_if(F.col("level") > 0).alias("n_quotes"),
        F.max("level").alias("deepest"),
    )
    key = ["conv", "turn", "message"]
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in key]
    out = messages.alias("m").join(durable(words, "words").alias("w"), same, "left").select(
        "m.conv", "m.turn", "m.role", "own", "n_quotes", "deepest"
    )
    return out.join(durable(tree, "tree"), ["conv", "turn"], "left").select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.coalesce(F.array_join(F.col("own.text"), "\n\n"), F.lit("")).alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("deepest", F.lit(0)).cast("long").alias("deepest"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def with_quotes(df: DataFrame) -> DataFrame:
    """The conversations as mail: each message below its predecessor's words, quoted, and those
    of the one before, quoted twice."""
    before = df.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_one"))
    earlier = df.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("_two"))

    def quoted(text: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))

    return df.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role",
        F.concat_ws("\n", quoted("_two", "> > "), quoted("_one", "> "), F.lit(""), "text").alias("text"),
    )
