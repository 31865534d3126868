"""Cross-site boilerplate lines by distinct-site spread, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsmill.functions.arrays import let
from newsmill.llm.common import lower_ascii, pick, text_key
from newsmill.session import durable

# Of an HLL sketch with 2^12 registers: relative standard error.
HLL_BITS = 12
HLL_ERROR = 1.04 / 2 ** (HLL_BITS / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_key(line: Column) -> list[Column]:
    """96 bits for a line: ends trimmed, A-Z lower-cased."""
    return [F.xxhash64(line).alias("h1"), F.crc32(line.cast("binary")).alias("h2")]


def spread_of_lines(lines: DataFrame, min_sites: int, sigmas: float = 6.0) -> DataFrame:
    """(h1, h2, sites, exact) of the lines on at least ``min_sites`` sites.

    ``lines`` has h1, h2 and site.  An HLL sketch per line is built before the shuffle and
    merged after it.  Where the estimate is within ``sigmas`` standard errors (and one site)
    of the threshold, the sites are counted exactly.  A null site is no site.
    """
    sketched = durable(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", HLL_BITS)).alias("estimate"))
        .where(F.col("estimate") >= min_sites * (1 - sigmas * HLL_ERROR) - 1),
        "spread",
    )
    sure = F.col("estimate") > min_sites * (1 + sigmas * HLL_ERROR) + 1
    counted = (
        lines.join(sketched.where(~sure).select("h1", "h2"), ["h1", "h2"])
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return sketched.where(sure).select("h1", "h2", F.col("estimate").alias("sites"), F.lit(False).alias("exact")).unionByName(
        counted.select("h1", "h2", "sites", F.lit(True).alias("exact"))
    )


def remove_boilerplate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
) -> DataFrame:
    """The same rows and columns with the text's cross-site lines left out, and two more:
    n_lines and n_removed.

    Lines are parted by newline.  Two lines are the same when they are equal after their blank
    ends are trimmed and A-Z lower-cased.  A line on ``min_sites`` distinct sites or more goes
    wherever it stands; blank lines stay.  A null text stays null (0 lines); an empty text has
    one blank line.  Columns of the table called n_lines or n_removed are replaced.

    Lines travel as hashes.  Texts are shuffled once, to meet the places of their removed
    lines.  Rows with equal ids and texts have equal results.
    """
    key = text_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    texts = df.select(*key, F.col(f"`{site_col}`").cast("string").alias("site"), F.col(f"`{text_col}`").alias("text"))
    lines = durable(
        texts.select("_id", "_hash", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.btrim(lower_ascii(F.col("line")), F.lit(" \t\r\x0b\x0c")))
        .where("line != ''")
        .select("_id", "_hash", "site", "pos", *_line_key(F.col("line"))),
        "lines",
    )
    spread = durable(spread_of_lines(lines, min_sites), "boilerplate")
    removed = (
        lines.join(spread.select("h1", "h2"), ["h1", "h2"])
        .groupBy("_id", "_hash")
        .agg(F.collect_set("pos").alias("_removed"))
    )

    def keep(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_removed"))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    # the row travels as one column, so its names cannot clash with the key's
    whole = df.select(*key, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    text = F.col("_row").getField(text_col)
    out = whole.join(removed, ["_id", "_hash"], "left")
    return out.select(
        *[
            (
                F.when(F.col("_removed").isNull(), text).otherwise(let(_lines(text), keep))
                if c == text_col
                else F.col("_row").getField(c)
            ).alias(c)
            for c in df.columns
            if c not in ("n_lines", "n_removed")
        ],
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
