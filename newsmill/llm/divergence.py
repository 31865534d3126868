"""How the sources of a language differ in their words: distances between sources, and the
terms that set a source apart, by cells of equal counts.

A share is p = 1 + floor(10^9 (count + 2) / (N + 2V)), and two shares differ by
f = floor((p - q)^2 / (p + q)).  Both depend on counts alone, so terms with equal counts are
one cell: f is evaluated once a cell and weighs as often as the cell has terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsmill.llm.common import lower_ascii, pick
from newsmill.session import durable

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
ONE = 1_000_000_000
GROUP = ["lang", "source"]


def _share(count: str, total: str) -> Column:
    """p of a count in a total; counts may exceed 2^63 / 10^9, so the product is a decimal."""
    return F.expr(f"1 + {ONE} * (CAST({count} AS DECIMAL(20,0)) + 2) div nullif({total} + 2 * CAST(terms AS DECIMAL(20,0)), 0)")


def _differ(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, count, lang_count): occurrences of the terms that stand in
    ``least_docs`` documents of their language or more; a row is a document.

    Occurrences and documents are summed before the shuffle, by source and then by language,
    so a source with a third of all rows sends each of its terms once a task."""
    found = docs.select(*GROUP, F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)).alias("found"))
    once = found.select(*GROUP, F.posexplode(F.array("found", F.array_distinct("found"))).alias("which", "found"))
    of_source = (
        once.select(*GROUP, "which", F.explode("found").alias("term"))
        .groupBy(*GROUP, "term")
        .agg(F.sum(1 - F.col("which")).alias("count"), F.sum("which").alias("docs"))
    )
    term = Window.partitionBy("lang", "term")
    return (
        of_source.withColumns({"lang_count": F.sum("count").over(term), "lang_docs": F.sum("docs").over(term)})
        .where(F.col("lang_docs") >= least_docs)
        .select(*GROUP, "term", "count", "lang_count")
    )


def group_totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms): every group of the documents with its N, that of
    its language, and V."""
    by_source = counts.groupBy(*GROUP).agg(F.sum("count").alias("total"))
    by_lang = counts.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count("*").alias("terms")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "lang_total", "terms")}
    return docs.select(*GROUP).distinct().join(by_source, GROUP, "left").join(by_lang, "lang", "left").withColumns(zero)


def telling_terms(counts: DataFrame, totals: DataFrame, top: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): terms more frequent in a source than in its language.

    Cells of (count, lang_count) are valued; cells of equal value are one; values go by
    descending order until the terms before them reach ``top``.  Only the terms of these are
    then put in UTF-8 order."""
    cells = (
        counts.groupBy(*GROUP, "count", "lang_count")
        .agg(F.count("*").alias("many"))
        .join(totals, GROUP)
        .withColumns({"p": _share("count", "total"), "q": _share("lang_count", "lang_total")})
        .where("p > q")
        .withColumn("value", _differ("p", "q"))
    )
    before = Window.partitionBy(*GROUP).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    values = (
        cells.groupBy(*GROUP, "value")
        .agg(F.sum("many").alias("many"))
        .withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0)))
        .where(F.col("before") < top)
    )
    kept = cells.join(values.select(*GROUP, "value"), [*GROUP, "value"]).select(*GROUP, "count", "lang_count", "value")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return (
        counts.withColumnRenamed("term", "item")
        .join(kept, [*GROUP, "count", "lang_count"])
        .select(*GROUP, "item", "value", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= top)
    )


def _tile(lang, a, b, frame, terms):
    """Sums of f over the terms of one bucket, for the pairs of sources of two tiles.

    Terms that neither tile has here are the cell of counts (0, 0): what is returned is the sum
    over the terms seen less their share of that cell, and the first bucket holds the whole cell."""
    import numpy as np
    import pandas as pd

    heads = frame[frame["term"].isna()].sort_values("source")
    rows = frame[frame["term"].notna()]
    names = heads["source"].to_numpy()
    place = {s: i for i, s in enumerate(names)}
    none = heads["p"].to_numpy(np.int64)
    codes, seen = pd.factorize(rows["term"])
    shares = np.repeat(none[:, None], len(seen), axis=1)
    shares[rows["source"].map(place).to_numpy(np.int64), codes] = rows["p"].to_numpy(np.int64)
    tiles = heads["tile"].to_numpy()
    first, second = np.flatnonzero(tiles == a), np.flatnonzero(tiles == b)
    left, right, sums = [], [], []
    for i in first:
        js = second[second > i] if a == b else second
        value = ((shares[i] - shares[js]) ** 2 // (shares[i] + shares[js])).sum(axis=1)
        empty = (none[i] - none[js]) ** 2 // np.maximum(none[i] + none[js], 1)
        left += [names[i]] * len(js)
        right += names[js].tolist()
        sums += (value + (terms - len(seen)) * empty).tolist()
    names = {"lang": [lang] * len(left), "source": left, "item": right}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in names.items()} | {"value": np.array(sums, np.int64)})


def source_distances(counts: DataFrame, totals: DataFrame, tile: int = 128, bucket: int = 4096) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by the sum of f over
    all terms kept.

    Sources are dealt into tiles of about ``tile`` and terms into buckets of about ``bucket``, so
    a task holds two tiles by one bucket whatever the size of the language or of a source.  A term
    travels once per tile that it meets, not once per pair of sources.  f is symmetric: each
    pair is summed once and returned both ways."""
    sizes = totals.groupBy("lang").agg(F.count("*").alias("sources"))
    heads = (
        totals.join(sizes, "lang")
        .withColumns({
            "tiles": F.ceil(F.col("sources") / tile).cast("int"),
            "buckets": F.greatest(F.ceil(F.col("terms") / bucket), F.lit(1)).cast("int"),
        })
        .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    )
    none = heads.withColumns({"count": F.lit(0), "p": F.coalesce(_share("count", "total"), F.lit(0))})
    columns = [*GROUP, "tile", "tiles", "bucket", "term", "p", "terms"]
    rows = (
        counts.join(heads, GROUP)
        .withColumns({"p": _share("count", "total"), "bucket": F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")})
        .select(*columns)
        .unionByName(
            none.withColumns({"bucket": F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)), "term": F.lit(None).cast("string")})
            .select(*columns)
        )
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    )

    def sums(key, frame):
        lang, a, b, bucket = key
        return _tile(lang, a, b, frame, int(frame["terms"].iloc[0]) if bucket == 0 else 0)

    half = (
        rows.select("lang", "a", "b", "bucket", "tile", "source", "term", "p", "terms")
        .groupBy("lang", "a", "b", "bucket")
        .applyInPandas(sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    both = half.select("lang", F.explode(F.array(
        F.struct("source", "item", "value"),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"),
    )).alias("pair")).select("lang", "pair.*")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order))


def source_audit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 10,
    top: int = 10,
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (item: every other source of the
    language) and ``term`` (item: the ``top`` terms that set the source apart).

    Null text, lang and source count as empty.  Repeated rows are documents of their own; columns
    other than the three named are not looked at.  A group without terms has pairs but no terms;
    a language without kept terms has pairs of value 0.  Equal values rank by item in UTF-8
    order.  An empty table gives an empty result."""
    docs = pick(df, text=text_col, lang=lang_col, source=source_col).na.fill("")
    counts = durable(term_counts(docs, least_docs), "terms")
    totals = durable(group_totals(docs, counts), "groups")
    pairs = source_distances(counts, totals).withColumn("part", F.lit("pair"))
    terms = telling_terms(counts, totals, top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
