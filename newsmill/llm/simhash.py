"""SimHash near-duplicates, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from newsmill.llm.common import components, partitions, pick, runs
from newsmill.session import durable

# The 64 bits as six stretches (first bit, width).  Fingerprints that differ in at most four
# bits agree on at least two of them.
STRETCHES = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
RADIUS = 4
SEEDS = (42, 43, 44, 45, 46, 47)


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """The SimHash of the text's word shingles as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[-n:].tolist()
    set_bits, done = np.zeros(64, np.int64), 0
    for at in range(0, n, 1 << 15):  # bounded memory for long texts
        hashes = [
            xxh64_intdigest(joined[s:e], seed)
            for s, e in zip(starts[at : min(n, at + (1 << 15))].tolist(), last[at : at + (1 << 15)])
        ]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += len(hashes)
    return int(np.packbits(set_bits * 2 > done, bitorder="little").view("<i8")[0])


def with_fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """(doc_id, fp); a text without words, or null, has fingerprint 0."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    texts = pick(df, doc_id=id_col, text=text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(each, f"doc_id {kind}, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        self.children[value] = {}
        if self.root is None:
            self.root = value
            return
        node = self.root
        while (nxt := self.children[node].setdefault((node ^ value).bit_count(), value)) != value:
            node = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def shard_links(stored: list[int], asking: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what lies within the radius, at most one per fingerprint beyond the first.

    Without ``asking`` the stored fingerprints are linked among themselves, else the asking
    ones to the stored.
    """
    tree, parent = BKTree(), {}
    if asking is not None:
        for x in stored:
            tree.add(x)
    for x in stored if asking is None else asking:
        for y in tree.within(x, radius):
            a, b = _find(parent, x), _find(parent, y)
            if a != b:
                parent[a] = b
                yield x, y
        if asking is None:
            tree.add(x)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tree_size: int = 2048) -> DataFrame:
    """Links (u, v) between the distinct values of column ``fp`` whose connected components
    are those of all pairs at most ``radius`` (up to 4) bits apart.

    A shard holds the fingerprints that agree on two of six stretches of their bits, so every
    pair in question meets in a shard.  Each shard has a BK-tree of at most ``tree_size`` or so
    nodes; a larger shard is dealt into pieces, and the tree of each piece goes to the
    fingerprints of every piece, unit by unit, so no task holds more than two pieces.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    masks = [
        sum(((1 << w) - 1) << b for b, w in pair) for pair in combinations(STRETCHES, 2)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    members = prints.select("fp").distinct().select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                    for t, m in enumerate(signed)
                ]
            )
        ).alias("s"),
    ).select("fp", "s.*")
    sizes = members.groupBy("t", "key").count().where("count > 1")
    pieces = F.ceil(F.col("count") / tree_size).cast("int")
    units = (
        members.join(sizes, ["t", "key"])
        .select("fp", "t", "key", pieces.alias("c"))
        .withColumn("p", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select(
            "t", "key", "fp",
            F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).alias("asks"),
        )
        .repartition(partitions(prints), "t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j", "asks")
    )

    def link(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: list[tuple[int, int]] = []
        waiting: tuple | None = None
        mask = (1 << 64) - 1

        def batch():
            u, v = zip(*found)
            out = pa.record_batch(
                [pa.array([x - (1 << 64) if x >> 63 else x for x in side], pa.int64()) for side in (u, v)],
                ["u", "v"],
            )
            found.clear()
            return out

        for (t, key, i, j, asks), values in runs(batches, ["t", "key", "i", "j", "asks"], "fp"):
            values = [int(x) & mask for x in values]
            if i == j:
                if len(values) > 1:
                    found += shard_links(values, None, radius)
            elif asks:
                if waiting and waiting[0] == (t, key, i, j):
                    found += shard_links(waiting[1], values, radius)
            else:
                waiting = (t, key, i, j), values
            if len(found) > 50_000:
                yield batch()
        if found:
            yield batch()

    return units.mapInArrow(link, "u long, v long").distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = RADIUS,
    tree_size: int = 2048,
) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id, links.

    Fingerprints at most ``radius`` bits apart are linked; component_id is the least doc_id
    that is reachable, the document itself included.  links is the number of tree links found
    at the document's fingerprint (0: none but its copies).  Null ids are no component's least id unless all are null.
    Null, empty and blank texts share fingerprint 0.  Repeated rows give repeated rows.
    """
    prints = durable(with_fingerprints(df, id_col, text_col, words), "prints")
    links = durable(fingerprint_links(prints, radius, tree_size), "links")
    roots = durable(components(links).withColumnRenamed("node", "fp"), "roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    degree = links.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    placed = (
        least.join(roots, "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .join(degree, "fp", "left")
    )
    component = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = placed.join(component, "root").select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return prints.join(known, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "links",
    )


def near_duplicate_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    radius: int = RADIUS,
    seeds: Sequence[int] = SEEDS,
) -> DataFrame:
    """(doc_id, component_id) of documents linked under any of several fingerprints.

    A pair of similar texts may lie just outside the radius under one seed and inside under
    another, so each further seed finds more of them.  Only documents in a group of two or
    more ids are returned, with the least id reachable.  Rows without an id are left out.
    """
    edges = None
    texts = df.where(F.col(f"`{id_col}`").isNotNull())
    for seed in seeds:
        prints = durable(with_fingerprints(texts, id_col, text_col, words, seed), "prints")
        least = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
        links = durable(fingerprint_links(prints, radius), "links")
        u, v = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v"))
        found = (
            prints.join(least, "fp")
            .where("doc_id != least")
            .select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
            .unionByName(
                links.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
            )
        )
        edges = found if edges is None else edges.unionByName(found)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
