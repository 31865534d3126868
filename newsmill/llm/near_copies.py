"""Near copies by the Jaccard similarity of word shingles: SimHash links through BK-trees, MinHash
buckets for what they leave apart, exact verification of both."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.llm.common import components, pick
from newsmill.llm.simhash import fingerprint, fingerprint_links
from newsmill.session import durable

MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; of a shorter text, of all
    its words.  Words part at ASCII blanks, with A-Z in lower case."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    words = min(words, len(tokens))
    n = len(tokens) - words + 1
    out = np.full(n, words, np.uint64)
    for j in range(words):
        out = ((out ^ (out >> np.uint64(29))) * MIX) + h[j : j + n]
    return np.unique((out ^ (out >> np.uint64(32))) * MIX)


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(shingles.tobytes())
    return key - (1 << 64) if key >> 63 else key


def minima(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The MinHash of a set under each function."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):  # bounded memory for long texts
        np.minimum(out, (factors[:, None] * shingles[at : at + 2048] + terms[:, None]).min(axis=1), out=out)
    return out


def sketch_longs(bands: int, rows: int) -> int:
    return -(-bands * rows // 16)


def _apart(a: Column, b: Column) -> Column:
    """How many of the 16 groups of four bits differ."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def with_buckets(texts: DataFrame, words: int, bands: int, rows: int, seed: int = 42) -> DataFrame:
    """(doc_id, key, size, fp, buckets, w0, ...): the shingle set's hash and size, the text's SimHash,
    a bucket per band of ``rows`` MinHashes, and four bits of each MinHash in longs w0, w1, ..."""

    longs = sketch_longs(bands, rows)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(seed)
        factors, terms = (rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) for _ in range(2))
        factors |= np.uint64(1)
        for batch in batches:
            keys, sizes, prints, buckets, bits = [], [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                low = minima(shingles, factors, terms)
                keys.append(set_key(shingles))
                sizes.append(len(shingles))
                prints.append(fingerprint(text.as_py(), words, seed))
                found = np.array([xxh64_intdigest(b.tobytes(), seed) for b in low.reshape(bands, rows)], np.uint64)
                buckets.append(found.view(np.int64))
                nibbles = np.zeros((longs, 16), np.uint64)
                nibbles.reshape(-1)[: len(low)] = (low >> np.uint64(20)) & np.uint64(15)
                bits.append((nibbles << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1).view(np.int64))
            yield pa.record_batch(
                [
                    batch.column(0), *(pa.array(c, pa.int64()) for c in (keys, sizes, prints)),
                    pa.array(buckets, pa.list_(pa.int64())), *map(pa.array, np.array(bits, np.int64).reshape(-1, longs).T),
                ],
                ["doc_id", "key", "size", "fp", "buckets", *(f"w{i}" for i in range(longs))],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(each, f"doc_id {kind}, key long, size long, fp long, buckets array<long>" + "".join(f", w{i} long" for i in range(longs)))


def _own_bodies(bodies: DataFrame, words: int) -> DataFrame:
    """The rows (key, text) whose text has the key, as ids may repeat with other texts."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            same = [set_key(shingle_set(t.as_py(), words)) == k.as_py() for k, t in zip(*batch.columns)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return bodies.mapInArrow(each, "key long, text string")


def _verified(pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """The (u, v) whose texts tu and tv are as similar as ``threshold`` or more."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            u, v, tu, tv = batch.columns
            same = []
            for a, b in zip(tu, tv):
                a, b = shingle_set(a.as_py(), words), shingle_set(b.as_py(), words)
                both = len(np.intersect1d(a, b, assume_unique=True))
                same.append(both >= threshold * (len(a) + len(b) - both))
            yield pa.record_batch([u, v], ["u", "v"]).filter(pa.array(same, pa.bool_()))

    return pairs.select("u", "v", "tu", "tv").mapInArrow(each, "u long, v long")


def _print_pairs(heads: DataFrame) -> DataFrame:
    """(u, v): keys whose SimHashes are equal or linked, a tree of pairs per group."""
    least = durable(heads.where("size > 0").groupBy("fp").agg(F.min("key").alias("least")), "prints")
    equal = heads.join(least, "fp").where("key != least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v"))
    near = fingerprint_links(least).join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return equal.unionByName(near)


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    bands: int = 20,
    rows: int = 5,
) -> DataFrame:
    """(doc_id, component_id) of documents linked by pairs whose sets of word shingles have a
    Jaccard similarity of ``threshold`` or more.

    Texts with equal sets are one node.  SimHashes at most four bits apart are linked through
    BK-trees, shard by shard; of a group of them a tree of pairs is verified, and what is similar
    enough starts as one component.  Other pairs are looked for in buckets of ``rows`` equal
    MinHashes, ``bands`` of them a text: a pair of similarity s meets with probability
    1 - (1 - s^rows)^bands, 99.96 % at 0.8.  Each is verified on the whole shingle sets before
    it links.  In a bucket all are compared with its first members, then those still apart from
    each other with sixteen times as many, until a bucket is one component or all its pairs are
    compared.  First are the texts that meet the most others over all bands: in a group of
    edited copies these are the ones nearest to the original, which link it at once where two
    copies may be too far from each other.  So a large group of copies costs a comparison a
    text, and none is left out.

    Texts without words are copies of each other.  Only documents in a group of two or more ids
    are returned, with the least id reachable.  Rows without an id are left out.
    """
    texts = pick(df, doc_id=id_col, text=text_col).where("doc_id is not null")
    sketch = [f"w{i}" for i in range(sketch_longs(bands, rows))]
    prints = durable(with_buckets(texts, words, bands, rows), "buckets")
    heads = durable(
        prints.groupBy("key").agg(
            F.min("doc_id").alias("head"),
            *[F.any_value(c).alias(c) for c in ("size", *sketch, "buckets")],
            F.min("fp").alias("fp"),
        ),
        "heads",
    )
    seats = heads.where("size > 0").select("key", "size", *sketch, F.posexplode("buckets").alias("band", "bucket"))
    crowded = seats.groupBy("band", "bucket").count().where("count > 1")
    seats = durable(seats.join(crowded, ["band", "bucket"]), "seats")
    crowd = seats.groupBy("key").agg(F.sum("count").alias("crowd"))
    seats = durable(seats.drop("count").join(crowd, "key"), "ranked")
    by_print = durable(_print_pairs(heads), "print_pairs")
    asked = seats.select("key").unionByName(by_print.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    wanted = asked.join(heads.select("key", F.col("head").alias("doc_id")), "key")
    bodies = durable(
        _own_bodies(texts.join(wanted, "doc_id").select("key", "text"), words).dropDuplicates(["key"]), "bodies"
    )
    u, v = (bodies.select(F.col("key").alias(c), F.col("text").alias(f"t{c}")) for c in ("u", "v"))
    links = durable(_verified(by_print.join(u, "u").join(v, "v"), words, threshold), "print_links")
    roots, centres = durable(components(links).select(F.col("node").alias("key"), "root"), "roots"), 1
    # four bits of a MinHash differ in 15 / 16 (1 - s) of cases; five standard deviations more are let pass
    p = (1 - threshold) * 15 / 16
    most = int(bands * rows * p + 5 * (bands * rows * p * (1 - p)) ** 0.5)
    while True:
        seats = seats.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = seats.groupBy("band", "bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"))
        seats = durable(seats.join(mixed.where("a != b").select("band", "bucket"), ["band", "bucket"]), "seats")
        if seats.isEmpty():
            break
        first = Window.partitionBy("band", "bucket").orderBy(F.desc("crowd"), "key")
        heart = durable(seats.withColumn("place", F.row_number().over(first)).where(F.col("place") <= centres), "centres")
        to = heart.select(
            "band", "bucket", F.col("key").alias("v"), *[F.col(c).alias(f"{c}_v") for c in ("size", *sketch, "root", "crowd")]
        )
        after = (F.col("crowd") < F.col("crowd_v")) | ((F.col("crowd") == F.col("crowd_v")) & (F.col("key") > F.col("v")))
        apart = reduce(add, [_apart(F.col(c), F.col(f"{c}_v")) for c in sketch])
        pairs = durable(
            seats.join(to, ["band", "bucket"])
            .where(after & (F.col("root") != F.col("root_v")) & (apart <= most))
            .where(F.least("size", "size_v") >= threshold * F.greatest("size", "size_v"))
            .select(F.col("key").alias("u"), "v")
            .distinct(),
            "pairs",
        )
        found = durable(_verified(pairs.join(u, "u").join(v, "v"), words, threshold), "links")
        links = links.unionByName(found)
        roots = durable(components(links).select(F.col("node").alias("key"), "root"), "roots")
        seats = seats.drop("root").join(heart.select("band", "bucket", "key"), ["band", "bucket", "key"], "left_anti")
        centres *= 16
    nodes = heads.select("key", "head").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = nodes.groupBy("root").agg(F.min("head").alias("component_id"))
    placed = durable(nodes.join(least, "root").select("key", "component_id"), "placed")
    members = prints.select("doc_id", "key").distinct().join(placed, "key")
    edges = members.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
