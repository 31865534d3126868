"""Target tables: S10-S14, S22, S24, S25, C10 pieces, A9, A15, O4, U3."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.operators.dedup import clean_table
from newsmill.operators.joins import new_rows


# --- column plans -----------------------------------------------------------

def output_columns(extra: Sequence[str], existing: Sequence[str] = ()) -> list[str]:
    """Canonical columns, sorted extras, then what the file already has."""
    out = list(fixed.CANONICAL_COLUMNS)
    out += sorted(set(extra) - set(out))
    return out + [c for c in existing if c not in out]


def align(df: DataFrame, columns: Sequence[str], missing: str | None = "") -> DataFrame:
    """Project to these columns as strings; a missing one is empty (``missing``), a checkbox ``FALSE``."""
    cells = []
    for c in columns:
        default = F.lit("FALSE" if c in fixed.CHECKBOX_COLUMNS else missing).cast("string")
        if c in df.columns:
            value = F.col(f"`{c}`").cast("string")
            value = F.coalesce(value, F.lit(missing).cast("string"))
        else:
            value = default
        cells.append(value.alias(c))
    return df.select(*cells)


def flatten_fields(items: DataFrame, names: Sequence[str], fields: str = "custom_fields") -> DataFrame:
    """The open fields as columns."""
    return items.select(
        *[c for c in items.columns if c != fields],
        *[F.try_element_at(F.col(fields), F.lit(n)).alias(n) for n in names],
    )


def field_names(items: DataFrame, fields: str = "custom_fields") -> list[str]:
    """Names that occur in the open fields.  They become columns, so they are few."""
    rows = items.select(F.explode(F.map_keys(fields)).alias("k")).distinct().collect()
    return sorted(r.k for r in rows)


# --- files ------------------------------------------------------------------

def write_csv(items: DataFrame, path: str, existing: Sequence[str] = (), mode: str = "append") -> list[str]:
    """Append items in canonical order; returns the columns written.

    A missing cell is empty, an empty text a pair of quotes; blanks at the ends of a cell and
    backslashes stand as they are, quotes are doubled.
    """
    if "custom_fields" in items.columns:
        items = flatten_fields(items, field_names(items))
    columns = output_columns(items.columns, existing)
    align(items, columns, missing=None).write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return columns


def read_csv(spark, path: str) -> DataFrame:
    """What :func:`write_csv` has written: an empty cell is null, a pair of quotes an empty text."""
    # No cell is a line break, so no text is taken for the null.
    return spark.read.options(header=True, escape='"', nullValue="\n", emptyValue="").csv(path)


def csv_columns(spark, path: str) -> list[str]:
    """Header of a CSV table, read from its files alone."""
    return spark.read.option("header", True).csv(path).columns


def read_evolving(spark, paths: Sequence[str]) -> DataFrame:
    """Several CSV tables with different headers as one table."""
    out = None
    for p in paths:
        part = spark.read.option("header", True).csv(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def training_rows(links: DataFrame, include_blocked: bool = True) -> DataFrame:
    """Rows of the training table, pre-marked when blocked or excluded."""
    marked = F.col("is_blocked") | F.col("matches_exclude")
    rows = links if include_blocked else links.where(~marked)
    quoted = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""'))
    return rows.select(
        "section",
        quoted("title").alias("title"),
        "url",
        "source",
        quoted("description").alias("description"),
        F.when(marked, "FALSE").otherwise("").alias("Track?"),
    )


def write_training(links: DataFrame, path: str, include_blocked: bool = True) -> None:
    training_rows(links, include_blocked).write.mode("overwrite").option("header", True).option(
        "quoteAll", True
    ).csv(path)


def review_counts(links: DataFrame) -> DataFrame:
    """A11."""
    marked = F.col("is_blocked") | F.col("matches_exclude")
    return links.agg(
        F.count_if(marked).alias("pre_marked"), F.count_if(~marked).alias("needs_review")
    )


def narrow_export(items: DataFrame) -> DataFrame:
    """S22."""
    return align(items, fixed.EXPORT_COLUMNS)


def clipboard_text() -> Column:
    """``[category] title`` and the URL below it."""
    return F.format_string("[%s] %s\n%s", F.col("category"), F.col("title"), F.col("url"))


def preview(
    items: DataFrame, override: Sequence[str] = (), configured: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Override, else configured, else the five default columns."""
    columns = list(override) or list(configured) or fixed.PREVIEW_COLUMNS
    out = align(items, columns)
    return out if rows is None else out.limit(rows)


def items_json(items: DataFrame, fields: str = "custom_fields") -> DataFrame:
    """One JSON object per item; open fields stand next to the fixed ones."""
    fixed_part = F.create_map(
        *[x for c in fixed.ITEM_JSON_FIELDS for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))]
    )
    extra = F.map_filter(
        F.coalesce(F.col(fields), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")),
        lambda k, v: ~k.isin(fixed.ITEM_JSON_FIELDS),
    )
    return items.select(F.to_json(F.map_concat(fixed_part, extra)).alias("item"))


# --- loading ----------------------------------------------------------------

def rows_to_append(
    items: DataFrame, target: DataFrame, key: str = "url", columns: Sequence[str] = ()
) -> DataFrame:
    """Items not in the target, in the target's columns.

    The target's own header wins over the wanted columns; an empty header means
    the wanted ones, else the item's.
    """
    header = target.columns or list(columns) or items.columns
    fresh = new_rows(items, target, key) if key in header and key in target.columns else items
    return align(fresh, header)


def append_new(
    items: DataFrame, target: DataFrame, key: str = "url", order: str = "row_no",
    sort_by: str | None = None,
) -> DataFrame:
    """The target after the append, cleaned up (W1, P25) and sorted.

    ``order`` numbers the target's rows; new rows come after them in the order of
    their own ``order`` column.
    """
    payload = [c for c in target.columns if c != order]
    fresh = new_rows(items, target, key)
    old = target.select(order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in payload])
    new = align_keep(fresh, payload, order)
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    clean = clean_table(both, key, ["_new", order], payload).drop("_new")
    return clean if sort_by is None else clean.orderBy(F.col(sort_by).asc_nulls_last(), order)


def align_keep(df: DataFrame, columns: Sequence[str], keep: str) -> DataFrame:
    cells = [
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns
         else F.lit("FALSE" if c in fixed.CHECKBOX_COLUMNS else "")).alias(c)
        for c in columns
    ]
    return df.select(keep, *cells)


def covered_days(target: DataFrame, date: str = "date_published") -> DataFrame:
    """Distinct days that have rows."""
    d = F.left(F.trim(F.col(date)), F.lit(10))
    return (
        target.select(d.alias("date"))
        .where((F.length("date") == 10) & (F.substr("date", F.lit(5), F.lit(1)) == "-"))
        .distinct()
    )


def day_bounds(target: DataFrame, date: str = "date_published") -> DataFrame:
    """Earliest and latest day and how many there are."""
    return covered_days(target, date).agg(
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.count(F.lit(1)).alias("covered"),
    )


def sort_target(target: DataFrame, date: str = "date_published", newest_first: bool = True) -> DataFrame:
    """O4."""
    c = F.nullif(F.col(date), F.lit(""))
    return target.orderBy(c.desc_nulls_last() if newest_first else c.asc_nulls_last())


def backfill_totals(posts: DataFrame, items: DataFrame, target: DataFrame) -> DataFrame:
    """Posts, items, rows that were new, and posts in error.

    ``posts``: url, error flag; ``items``: url of each item found.
    """
    p = posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if("error").alias("errors"))
    i = items.agg(F.count(F.lit(1)).alias("items"))
    n = new_rows(items, target).agg(F.count(F.lit(1)).alias("new_rows"))
    # Three one-row tables become one row: an aggregate over their union.
    parts = [
        p.select("posts", "errors", F.lit(None).cast("long").alias("items"), F.lit(None).cast("long").alias("new_rows")),
        i.select(F.lit(None).cast("long").alias("posts"), F.lit(None).cast("long").alias("errors"), "items", F.lit(None).cast("long").alias("new_rows")),
        n.select(F.lit(None).cast("long").alias("posts"), F.lit(None).cast("long").alias("errors"), F.lit(None).cast("long").alias("items"), "new_rows"),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.agg(*[F.max(c).alias(c) for c in ("posts", "items", "new_rows", "errors")])


def item_map(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Add computed open fields; a field that fails is left out."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()]),
        lambda e: e["v"].isNotNull(),
    )
    return df.withColumn("custom_fields", F.map_from_entries(entries))
