"""Exact duplicates by deterministic block naming, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.functions.arrays import let
from newsmill.llm.common import dense_names, lower_ascii, pick
from newsmill.session import durable


def _blocks(text: Column, size: int) -> Column:
    """The UTF-8 bytes in blocks of ``size``; an empty text has one empty block."""

    def cut(b: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(b) / size), F.lit(1)).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size))
        )

    return let(text.cast("binary"), cut)


def block_identities(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4096,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """A row per document: row, doc_id, text_sha256, level and name.

    Two texts, A-Z lower-cased, are equal if and only if level and name are equal.

    Each text is cut into blocks of ``block_bytes``.  The distinct blocks of the corpus are
    sorted by (digest, bytes), and a block's place is its integer name.  Bytes only decide
    between blocks of one digest, so they are shuffled once, in a distinct, to find digests
    that stand for several blocks; all else moves digests.  Then names of neighbours are
    paired, and the distinct pairs sorted and named, until each text has one name.  level is
    the number of rounds; it grows with the logarithm of the longest text.

    A null text counts as empty.  Rows repeated or without an id are documents of their own.
    An empty table gives no rows.
    """
    texts = pick(df, doc_id=id_col, text=text_col).withColumn("text", lower_ascii(F.col("text")))
    blocks = _blocks(F.col("text"), block_bytes)
    rows = durable(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(blocks, lambda b: digest(b)).alias("digests"),
        ),
        "rows",
    )
    distinct = (
        texts.select(F.explode(blocks).alias("block"))
        .select(digest(F.col("block")).alias("digest"), "block")
        .distinct()
    )
    shared = distinct.groupBy("digest").count().where("count > 1").select("digest")
    ties = durable(
        distinct.join(shared, "digest").withColumn(
            "tie", F.row_number().over(Window.partitionBy("digest").orderBy("block"))
        ),
        "ties",
    )
    level = rows.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    if ties.isEmpty():
        level = level.withColumn("tie", F.lit(1))
    else:
        told = (
            texts.select(
                "doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(blocks).alias("pos", "block")
            )
            .withColumn("digest", digest(F.col("block")))
            .join(ties, ["digest", "block"])
            .select("doc_id", "text_sha256", "pos", "tie")
            .distinct()
            .alias("t")
        )
        keyed = rows.select("row", "doc_id", "text_sha256").join(level, "row").alias("l")
        same = (
            F.col("l.doc_id").eqNullSafe(F.col("t.doc_id"))
            & (F.col("l.text_sha256") == F.col("t.text_sha256"))
            & (F.col("l.pos") == F.col("t.pos"))
        )
        level = keyed.join(told, same, "left").select(
            "row", "n", "l.pos", "digest", F.coalesce("tie", F.lit(1)).alias("tie")
        )
    rounds = max(1, rows.agg(F.max(F.size("digests"))).first()[0] or 1)
    keys, found = ["digest", "tie"], []
    for k in range((rounds - 1).bit_length() + 1):
        level = durable(level, "level")
        named = level.join(dense_names(level, *keys), keys)
        found.append(named.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
        level = (
            named.where("n > 1")
            .groupBy(
                "row",
                F.ceil(F.col("n") / 2).cast("int").alias("n"),
                F.shiftright("pos", 1).alias("pos"),
            )
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
            )
        )
        keys = ["left", "right"]
    names = found[0]
    for more in found[1:]:
        names = names.unionByName(more)
    return rows.drop("digests").join(names, "row")


def exact_duplicates(df: DataFrame, **options) -> DataFrame:
    """``block_identities`` with the groups: keep_id, group_size and kept.

    Of equal texts the row with the largest id stays; of rows that share that id, one; a
    null id is smaller than any other.  Groups are counted before the shuffle, and a large
    group's rows are joined to its one line of counts.
    """
    named = durable(block_identities(df, **options), "named")
    groups = named.groupBy("level", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "level",
        "name",
    )
