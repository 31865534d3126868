"""Joins: J1, J2, J4-J13.

Substring joins never run as a cross join: literal patterns go over the texts as automata
(:mod:`newsmill.operators.automata`), short strings are joined on character grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill.functions.arrays import col
from newsmill.operators.automata import first_string, string_counts
from newsmill.operators.rows import unnest
from newsmill.session import durable

GRAM = 3


# --- equi joins that survive a hot key --------------------------------------

def _splits_hot_partitions(spark: SparkSession) -> bool:
    on = lambda key: spark.conf.get(key, "true").lower() == "true"
    return on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled")


def skew_join(
    big: DataFrame,
    other: DataFrame,
    key: str,
    how: str = "inner",
    salts: int = 16,
    hot_share: float = 0.005,
    force_salt: bool = False,
) -> DataFrame:
    """Join where a key of ``big`` may hold a large share of its rows.

    With adaptive execution on, Spark splits an oversized join partition over
    several tasks by itself and without another pass, so the plain join is used.
    Otherwise the keys above ``hot_share`` of all rows are counted (there are at
    most ``1 / hot_share`` of them, which bounds the broadcast set); their rows
    spread over ``salts`` groups and only the matching rows of ``other`` repeat.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if not force_salt and _splits_hot_partitions(big.sparkSession):
        return big.join(other, key, how)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = big.agg((F.count(F.lit(1)) * hot_share).alias("_min")).scalar()
    hot = counts.where((F.col("_n") > least) & F.col(key).isNotNull()).select(
        F.col(key).alias("_hot")
    )
    others = [F.col(c) for c in big.columns if c != key] or [F.col(key)]
    spread = F.pmod(F.xxhash64(*others), F.lit(salts))
    left = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").select(
        *big.columns,
        F.when(F.col("_hot").isNotNull(), spread).otherwise(F.lit(0)).cast("int").alias("_salt"),
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    right = other.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").select(
        *other.columns,
        F.explode(
            F.when(F.col("_hot").isNotNull(), every_salt).otherwise(F.array(F.lit(0)))
        ).alias("_salt"),
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def new_rows(items: DataFrame, target: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose trimmed key is not in the target yet."""
    known = target.select(F.trim(F.col(key)).alias("_key")).where("_key <> ''").distinct()
    keyed = items.withColumn("_key", F.trim(F.coalesce(F.col(key), F.lit(""))))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def uncovered(posts: DataFrame, covered: DataFrame, day: str = "date") -> DataFrame:
    """Posts on days without rows; undated posts stay."""
    days = covered.select(F.col(day).alias("_day")).where("_day is not null").distinct()
    return posts.join(days, posts[day] == F.col("_day"), "left_anti")


def named_only(sources: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Sources in a list of names."""
    return sources.join(names.select(name).distinct(), name, "left_semi")


def flag_present(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Mark rows whose key occurs on the right."""
    marks = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(marks, list(keys), "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def resolve_redirects(
    items: DataFrame,
    redirects: DataFrame,
    url: str = "url",
    out: str = "final_url",
) -> DataFrame:
    """Follow redirect chains to their ends, however long.

    The chains are shortened on the redirect table itself, which halves them with
    each join, so the items are joined once.  Each round leaves fewer chains open; when
    it does not, those left are cycles, and a URL that leads into one keeps its own
    address.
    """
    hops = redirects.select(F.col("url").alias("_from"), F.col("target").alias("_to")).where(
        "_from is not null and _to is not null and _from <> _to"
    )
    hops = hops.groupBy("_from").agg(F.min("_to").alias("_to"))
    hops = durable(hops, "hops")
    starts = hops.select(F.col("_from").alias("_via"))
    ends, before = hops, None
    while True:
        left = ends.join(starts, F.col("_to") == F.col("_via"), "left_semi").count()
        if left in (0, before):
            break
        before = left
        step = ends.select(F.col("_from").alias("_via"), F.col("_to").alias("_next"))
        ends = durable(
            ends.join(step, F.col("_to") == F.col("_via"), "left").select(
                "_from", F.coalesce("_next", "_to").alias("_to")
            ),
            "hops",
        )
    finished = ends.join(starts, F.col("_to") == F.col("_via"), "left_anti")
    joined = skew_join(
        items.withColumn("_from", F.col(url)), finished.select("_from", "_to"), "_from", "left"
    )
    return joined.withColumn(out, F.coalesce("_to", url)).drop("_from", "_to")


def update_titles(target: DataFrame, posts: DataFrame) -> DataFrame:
    """Replace cut-off titles by the full ones found for the same URL.

    Of several full titles the latest post wins, by its ``pos`` column.
    """
    full = (
        posts.where("url <> '' and title <> ''")
        .groupBy(F.trim("url").alias("_url"))
        .agg(F.max_by("title", "pos").alias("_full"))
    )
    keyed = target.withColumn("_url", F.trim("url"))
    stale = F.contains(F.col("title"), F.lit("...")) & (F.col("_full") != F.col("title"))
    return (
        keyed.join(full, "_url", "left")
        .withColumn("title", F.when(stale, F.col("_full")).otherwise(F.col("title")))
        .drop("_url", "_full")
    )


def update_columns(
    target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], order: str | None = None
) -> DataFrame:
    """Write new values over old ones where a row has been updated.

    Of several updates of a row the one with the largest ``order`` counts, or, without an
    order, the largest values; a row stays one row.
    """
    values = F.struct(*[F.col(c).alias(f"_new_{c}") for c in columns])
    best = F.max(values) if order is None else F.max_by(values, order)
    new = updates.groupBy(key).agg(best.alias("_new")).select(key, "_new.*")
    joined = target.join(new, key, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def later_state(stored: DataFrame, memory: DataFrame, key: str = "task_id", value: str = "last_run") -> DataFrame:
    """Reconcile two copies of a state; the later value wins."""
    a = stored.select(key, F.col(value).alias("_a"))
    b = memory.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.greatest("_a", "_b").alias(value))


# --- substring joins --------------------------------------------------------

def _grams(text: Column, size: int) -> Column:
    starts = F.when(
        F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def contains_join(
    needles: DataFrame,
    hays: DataFrame,
    needle: str,
    hay: str,
    short_needles: bool = False,
) -> DataFrame:
    """Distinct pairs (needle, hay) where the hay contains the needle; exact.

    Every hay that contains a needle holds all of its grams, so it is enough to
    join on one of them: the one that fewest hays hold.  Needles shorter than a
    gram take part with ``short_needles``; they join on themselves.
    """
    sizes = range(1 if short_needles else GRAM, GRAM + 1)
    n = needles.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    h = hays.select(F.col(hay).alias("_hay")).where("_hay <> ''").distinct()
    grams = F.array_distinct(F.concat(*[_grams(F.col("_hay"), s) for s in sizes]))
    in_hay = unnest(h, grams, "_gram", "_i", "_hay").drop("_i")
    shares = in_hay.groupBy("_gram").agg(F.count(F.lit(1)).alias("_hays"))
    own = F.array_distinct(_grams(F.col("_needle"), GRAM))
    if short_needles:
        own = F.when(F.length("_needle") >= GRAM, own).otherwise(F.array("_needle"))
    else:
        n = n.where(F.length("_needle") >= GRAM)
    # A needle with a gram that no hay holds is dropped: it has no match.
    candidates = n.select("_needle", F.explode(own).alias("_gram")).join(shares, "_gram", "left")
    rarest = (
        candidates.groupBy("_needle")
        .agg(F.min(F.struct(F.coalesce("_hays", F.lit(0)).alias("c"), F.col("_gram").alias("g"))).alias("m"))
        .where("m.c > 0")
        .select("_needle", F.col("m.g").alias("_gram"))
    )
    pairs = rarest.join(in_hay, "_gram").where(F.contains(F.col("_hay"), F.col("_needle")))
    return pairs.select(F.col("_needle").alias(needle), F.col("_hay").alias(hay))


def first_pattern(
    df: DataFrame,
    text: Column | str,
    patterns: DataFrame,
    pattern: str = "pattern",
    order: str = "priority",
    values: Sequence[str] = (),
) -> DataFrame:
    """Attach the values of the first pattern contained in a text: by order, then by
    the pattern; patterns without an order come last.

    Compared in lower case; rows without a match get nulls.  Patterns that are equal in
    lower case are one before they meet the texts.
    """
    place = F.struct(
        F.col(order).isNull().alias("_last"), F.col(order).alias("_order"), F.col(pattern).alias("_own"),
        *[F.col(v).alias(f"_by_{i}") for i, v in enumerate(values)],
    )
    table = durable(
        patterns.where(F.col(pattern) != "")
        .select(F.lower(pattern).alias("_string"), place.alias("_place"), F.struct(*values).alias("_values"))
        .groupBy("_string")
        .agg(F.min(F.struct("_place", "_values")).alias("_first"))
        .select("_string", "_first._place._last", "_first._place._order", "_first._place._own", "_first._values"),
        "patterns",
    )
    found = first_string(df, F.lower(col(text)), table, "_found").withColumn("_string", F.col("_found._string"))
    best = table.select("_string", "_values.*")
    return skew_join(found, best, "_string", "left").drop("_found", "_string")


# --- terms in documents -----------------------------------------------------

def term_counts(
    docs: DataFrame,
    terms: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    term: str = "term",
    ascii_boundary: bool = False,
) -> DataFrame:
    """How often each term stands in each document as whole words, case ignored.

    Terms of any length, with or without words in them, are looked for at once where the
    documents lie; only hits move.  A term does not overlap itself.
    """
    wanted = terms.select(F.col(term).alias("_term"), F.lower(term).alias("_low")).where("_term <> ''").distinct()
    texts = docs.select(key, F.col(text).alias("_text"))
    counted = string_counts(texts, F.lower("_text"), wanted, "_low", "_found", ascii_boundary)
    hits = unnest(counted, "_found", "_hit", "_i", key).select(key, F.col("_hit.string").alias("_low"), F.col("_hit.n").alias("n"))
    return skew_join(hits, wanted, "_low").select(key, F.col("_term").alias(term), "n")
