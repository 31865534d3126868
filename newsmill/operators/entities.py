"""Entity matching: J3 with F8 and F9, O8, A12, A2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsmill import fixed
from newsmill.functions import text as tx
from newsmill.operators.automata import strings_in
from newsmill.operators.dedup import keep_first
from newsmill.operators.joins import skew_join
from newsmill.operators.rows import settle, unnest
from newsmill.session import durable

TYPES = ["profile", "product", "asset", "entity"]
CATALOGUE = ["entity_id", "type", "name", "description", "ticker"]


def type_rank(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), k)


def _substrings(names: DataFrame, longest: int) -> DataFrame:
    """(_name, _kw): every substring of up to ``longest`` characters of each name."""
    starts = names.select("_name", F.explode(F.sequence(F.lit(1), F.length("_name"))).alias("_at"))
    most = F.least(F.length("_name") - F.col("_at") + 1, F.lit(longest))
    return starts.select("_name", "_at", F.explode(F.sequence(F.lit(1), most)).alias("_n")).select(
        "_name", F.substr(F.col("_name"), F.col("_at"), F.col("_n")).alias("_kw")
    ).distinct()


def keyword_candidates(keywords: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Pairs of keyword and entity that can reach the score threshold.

    An entity is a candidate when its name or its description holds the keyword.
    If only the description does, the score reaches the threshold only when the
    name is a part of the keyword; other such entities are not looked at.
    Entities of one name score the same and only the first of them is kept per
    item, so the first per name stands for all.  Names that hold a keyword are found by an
    index of the names' substrings (a name is short, and none is longer than the
    longest keyword), names within a keyword by an automaton of the names.
    """
    entities = catalogue.select(
        *CATALOGUE, F.lower("name").alias("_name"), type_rank("type").alias("_rank")
    ).where("_name <> ''")
    # Used by both lookups, so it is built once.
    first = durable(keep_first(entities, ["_name"], ["_rank", "entity_id"]), "names")
    kws = durable(keywords.select("_kw").where("_kw <> ''").distinct(), "distinct_keywords")
    shown = [*CATALOGUE, "_rank"]
    longest = kws.agg(F.max(F.length("_kw"))).first()[0] or 0
    by_name = kws.join(_substrings(first.select("_name"), longest), "_kw")
    forward = skew_join(by_name, first, "_name").select("_kw", *shown)
    within = unnest(strings_in(kws, F.col("_kw"), first, "_name", "_found"), "_found", "_hit", "_i", "_kw")
    inside = within.select("_kw", F.col("_hit.string").alias("_name")).where("_name <> _kw")
    described = skew_join(inside, entities, "_name").where(
        F.contains(F.lower(F.coalesce("description", F.lit(""))), F.col("_kw"))
    )
    backward = keep_first(described, ["_kw", "_name"], ["_rank", "entity_id"]).select("_kw", *shown)
    pairs = forward.unionByName(backward).withColumn("_name", F.lower("name"))
    return settle(pairs.withColumn("_parts", tx.score_parts("_name", "_kw")))


def match_entities(
    items: DataFrame,
    catalogue: DataFrame,
    key: Sequence[str],
    title: str = "title",
    description: str = "description",
    threshold: float = fixed.MATCH_THRESHOLD,
    ascii_boundary: bool = False,
) -> DataFrame:
    """One row per item and matched entity name, with score and place.

    A text is read once: for its keywords, for the catalogue's names in it and for the legal
    suffixes in it, which is all that a score asks of it.  What is joined are keywords and
    names.  Distinct keywords are joined to the catalogue, not items: a keyword that stands in
    a third of all items is looked up once.
    """
    full = F.concat_ws(
        " ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit(""))
    )
    read = text_facts(items.select(*key, full.alias("_full")), catalogue, "_full", key, ascii_boundary)
    scored = scored_keywords(keywords_of(read, key), catalogue, names_in(read, key), key)
    accepted = settle(scored).where(F.col("score") >= threshold)
    return keep_first(accepted, [*key, "_name"], ["pos", "_rank", "entity_id"]).select(
        *key, "keyword", "pos", *CATALOGUE, "score", F.col("_rank").alias("type_rank")
    )


def text_facts(
    items: DataFrame, catalogue: DataFrame, text: str, key: Sequence[str], ascii_boundary: bool = False, **more: Column
) -> DataFrame:
    """What matching asks of a text: its keywords, the catalogue's names and the legal suffixes in it.

    ``more``: columns of the items that go along.  Keywords and names are used several times; the
    texts are read once.
    """
    texts = settle(items.select(*key, text)).withColumn("_low", F.lower(text))
    names = catalogue.select(F.lower("name").alias("_name"))
    read = strings_in(texts, F.col("_low"), names, "_name", "_names", ascii_boundary)
    return durable(
        read.select(
            *key, tx.keywords(text, ascii_boundary=ascii_boundary).alias("_keywords"), "_names",
            tx.suffixes_in("_low").alias("_suffixes"), *[c.alias(name) for name, c in more.items()],
        ),
        "keywords",
    )


def keywords_of(read: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row per keyword of :func:`text_facts`."""
    rows = unnest(read, "_keywords", "keyword", "pos", *key, "_suffixes")
    return rows.withColumn("_kw", F.lower("keyword"))


def names_in(read: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row per catalogue name in a text, and whether it stands there as a word."""
    return unnest(read, "_names", "_found", "_i", *key).select(
        *key, F.col("_found.string").alias("_name"), F.col("_found.word").alias("_word")
    )


def scored_keywords(keywords: DataFrame, catalogue: DataFrame, in_text: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every keyword of an item with every entity that it may name, and the score."""
    candidates = durable(keyword_candidates(keywords, catalogue), "candidates")
    # Most keywords name nothing, and go before anything is grouped; a repeated one counts once.
    kws = keywords.join(candidates.select("_kw").distinct(), "_kw", "left_semi").groupBy(*key, "_kw").agg(
        F.min(F.struct("pos", "keyword", "_suffixes")).alias("_first")
    ).select(*key, "_kw", "_first.*")
    hits = skew_join(kws, candidates, "_kw")
    return hits.join(in_text, [c for c in key if c in in_text.columns] + ["_name"], "left").withColumn(
        "score", tx.score_of_facts("_parts", "_word", "_suffixes")
    )


def match_summary(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """The fixed match columns per item, best score first."""
    entry = F.struct(
        F.negate("score").alias("s"), "pos", "type_rank", "entity_id", "type", "name", "ticker"
    )
    packed = matches.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("m"))

    def first(kind: str, field: str) -> Column:
        of_type = F.filter("m", lambda x: x["type"] == kind)
        return F.coalesce(F.get(of_type, F.lit(0))[field], F.lit(""))

    m = F.col("m")
    return packed.select(
        *key,
        first("asset", "entity_id").alias("grid_asset_id"),
        F.lit(True).alias("grid_matched"),
        first("profile", "entity_id").alias("grid_profile_id"),
        F.round(F.negate(m[0]["s"]), 2).alias("grid_confidence"),
        first("entity", "name").alias("grid_entity_name"),
        F.size(m).cast("long").alias("grid_match_count"),
        first("product", "entity_id").alias("grid_product_id"),
        first("profile", "name").alias("grid_profile_name"),
        first("product", "name").alias("grid_product_name"),
        first("entity", "entity_id").alias("grid_entity_id"),
        first("asset", "name").alias("grid_asset_name"),
        F.array_join(F.transform(m, lambda x: x["name"]), ", ").alias("grid_subjects"),
        first("asset", "ticker").alias("grid_asset_ticker"),
    )


MATCH_COLUMNS = [
    "grid_asset_id", "grid_matched", "grid_profile_id", "grid_confidence", "grid_entity_name",
    "grid_match_count", "grid_product_id", "grid_profile_name", "grid_product_name",
    "grid_entity_id", "grid_asset_name", "grid_subjects", "grid_asset_ticker",
]


def with_match_columns(items: DataFrame, summary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items with their match columns; an item without a match gets the empty form."""
    empty = {
        "grid_matched": F.lit(False), "grid_confidence": F.lit(0.0),
        "grid_match_count": F.lit(0).cast("long"),
    }
    joined = items.join(summary, list(key), "left")
    return joined.select(
        *items.columns,
        *[F.coalesce(F.col(c), empty.get(c, F.lit(""))).alias(c) for c in MATCH_COLUMNS],
    )


def matched_total(items: DataFrame, flag: str = "grid_matched") -> DataFrame:
    """A2."""
    return items.agg(
        F.count_if(F.col(flag)).alias("matched"), F.count(F.lit(1)).alias("total")
    )


def top_subjects(names: Column, shown: int = 3) -> Column:
    """The first names, then how many more there are."""
    more = F.size(names) - shown
    return F.concat(
        F.array_join(F.slice(names, 1, shown), ", "),
        F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""),
    )
