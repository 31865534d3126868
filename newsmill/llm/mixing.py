"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.llm.common import text_key
from newsmill.session import durable

WORD = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``weight``, none above its ``capacity``;
    what a child cannot take goes to its siblings, in proportion to their weights.

    Children are taken in the order of capacity / weight: the first ones are full, the rest
    share what is left at one rate.  Adds ``grant``, whole tokens rounded down.
    """
    usable = F.col("weight") > 0
    nodes = nodes.withColumn("_c", F.when(usable, F.col("capacity")).otherwise(0)).withColumn(
        "_w", F.when(usable, F.col("weight").cast("double")).otherwise(1.0)
    )
    by = Window.partitionBy(*parents).orderBy(F.col("_c") / F.col("_w"), name)
    before = F.coalesce(F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(*parents)
    return (
        nodes.withColumn("_full", before + F.col("_c") / F.col("_w") * rest <= F.col("budget"))
        .withColumn(
            "_rate",
            (F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_c"))).over(every), F.lit(0)))
            / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every),
        )
        .withColumn(
            "grant",
            F.when(F.col("_full"), F.col("_c")).otherwise(F.floor(F.col("_w") * F.col("_rate"))).cast("long"),
        )
        .drop("_c", "_w", "_full", "_rate")
    )


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    budget: int,
    epochs: int,
) -> DataFrame:
    """Leaves with their ``grant`` of tokens.

    A node's capacity is the tokens below it times ``epochs``.  From the root down each node
    deals its grant to its children; as a grant never exceeds a capacity, a shortage is met by
    siblings first and reaches an ancestor's siblings only when all of a node's leaves are full.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    granted = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        weight = F.lit(1.0)
        if weights.get(level):
            known = F.create_map(*[F.lit(x) for kv in weights[level].items() for x in (kv[0], float(kv[1]))])
            weight = F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == F.col(level))), F.lit(0)), weight)
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight)
        if granted is None:
            nodes = nodes.withColumn("budget", F.lit(budget))
        else:
            nodes = nodes.join(granted.withColumnRenamed("grant", "budget"), path[:-1])
        granted = fill(nodes, path[:-1], level).select(*path, "grant")
    return leaves.drop("capacity").join(granted, list(levels))


def mix(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, float]],
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int | None = None,
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """A row per document and epoch that is taken: doc_id, epoch, the levels, n_tokens, taken,
    _id and _hash (to find the row again).

    ``levels`` name the tree's levels, root first, with the column that gives a document's node;
    ``weights`` the nodes' weights by level (1 where not named; 0: none).  The budget is in
    tokens, here words, or a ``share`` of all tokens.  A leaf takes whole epochs while its grant
    lasts, then the first tokens of one more, in an order seeded by epoch; the last document
    of that prefix is taken in part (taken < n_tokens).  No leaf is read more than ``epochs``
    times.  Null nodes are the node ''.  Null texts have no tokens and are never taken, as are
    texts without words.  Repeated rows count as often as they stand.

    A leaf's order is cut into 16^3 bins of hash; their sums, aggregated before the shuffle,
    tell which bins are taken whole, so only one bin per leaf is sorted.
    """
    names = list(levels)
    docs = durable(
        df.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            *text_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")),
            *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
            F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        ).where("n_tokens > 0"),
        "tokens",
    )
    leaves = durable(docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    granted = durable(
        budgets(leaves, names, weights, budget, epochs)
        .withColumn("whole", F.floor(F.col("grant") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("grant") - F.col("whole") * F.col("tokens"))
        .where("grant > 0")
        .drop("tokens"),
        "grants",
    )
    placed = docs.join(granted, names)
    whole = placed.where("whole > 0").select(
        "doc_id", "_id", "_hash", *names, "n_tokens",
        F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"),
        F.col("n_tokens").alias("taken"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = placed.where("rest > 0").withColumn("key", key).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    before = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        part.groupBy(*names, "bin")
        .agg(F.sum("n_tokens").alias("bin_tokens"))
        .withColumn("bin_start", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    )
    bins = durable(bins, "bins")
    reached = part.join(bins, [*names, "bin"]).where("bin_start < rest")
    out = ["doc_id", "_id", "_hash", *names, "n_tokens", F.col("whole").alias("epoch")]
    inner = reached.where("bin_start + bin_tokens <= rest").select(*out, F.col("n_tokens").alias("taken"))
    run = Window.partitionBy(*names).orderBy("key", "doc_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        reached.where("bin_start + bin_tokens > rest")
        .withColumn("start", F.col("bin_start") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
        .where("start < rest")
        .select(*out, F.least(F.col("n_tokens"), F.col("rest") - F.col("start")).alias("taken"))
    )
    return whole.unionByName(inner).unionByName(edge)
