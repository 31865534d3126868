"""Rule tables: J2, P7, P19, P23, P29, U4, U6."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from newsmill.functions.arrays import col, contains_any_of, let, strings
from newsmill.functions.urls import bare_host, netloc
from newsmill.operators.joins import first_pattern

ARRAYS = [
    "include_patterns", "exclude_patterns", "exclude_categories", "exclude_sections",
    "include_sections", "allowed_domains", "blocked_domains", "allowed_source_domains",
]
FLAGS = ["require_url", "require_include_pattern", "extract_markets_section"]


def rule_columns(rule: Mapping[str, Any] | None = None) -> dict[str, Column]:
    """Literal columns of one rule set; what is not given is off."""
    rule = rule or {}
    out = {name: strings(rule.get(name) or []) for name in ARRAYS}
    out |= {name: F.lit(bool(rule.get(name, False))) for name in FLAGS}
    return out


def attach_rules(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    overrides: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Columns of the first rule set (by ``rule_order``) whose pattern is in the URL.

    ``overrides`` win over what the rule set says.  Pages without a rule set get
    empty lists and false flags.
    """
    flat = rules.select(
        F.explode("source_url_patterns").alias("pattern"),
        F.struct("rule_order", "name").alias("priority"),
        F.col("name").alias("rule_name"),
        *[F.col(c) for c in ARRAYS + FLAGS if c in rules.columns],
    )
    given = [c for c in ARRAYS + FLAGS if c in rules.columns]
    packed = flat.select(
        "pattern", "priority", F.to_json(F.struct("rule_name", *given)).alias("_rule")
    )
    schema = "struct<rule_name:string," + ",".join(
        f"{c}:{'array<string>' if c in ARRAYS else 'boolean'}" for c in given
    ) + ">"
    out = first_pattern(pages, url, packed, values=["_rule"]).withColumn(
        "_rule", F.from_json("_rule", schema)
    )
    defaults = rule_columns()
    forced = rule_columns(overrides)
    for c in ARRAYS + FLAGS:
        if overrides and c in overrides:
            value = forced[c]
        elif c in given:
            value = F.coalesce(F.col(f"_rule.{c}"), defaults[c])
        else:
            value = defaults[c]
        out = out.withColumn(c, value)
    return out.withColumn("rule_name", F.col("_rule.rule_name")).drop("_rule")


def reject_reason(
    url: Column | str,
    text: Column | str,
    context: Column | str,
    category: Column | str,
    rule: Mapping[str, Column],
) -> Column:
    """The gate an item fails at, or null when it passes; an empty list is off."""
    u, c = col(url), F.coalesce(col(category), F.lit(""))
    combined = F.lower(F.concat_ws(" ", *[F.coalesce(col(x), F.lit("")) for x in (url, text, context)]))
    host = netloc(u)
    on = lambda name: F.size(rule[name]) > 0
    in_host = lambda name: let(host, lambda h: F.exists(rule[name], lambda d: F.contains(h, d)))
    no_url = F.coalesce(F.trim(u), F.lit("")).isin("", "#")
    return (
        F.when(rule["require_url"] & no_url, "no_url")
        .when((c != "") & contains_any_of(F.lower(c), rule["exclude_categories"]), "category")
        .when(on("include_patterns") & ~contains_any_of(combined, rule["include_patterns"]), "not_included")
        .when(contains_any_of(combined, rule["exclude_patterns"]), "excluded")
        .when(on("allowed_domains") & ~in_host("allowed_domains"), "domain_not_allowed")
        .when(in_host("blocked_domains"), "domain_blocked")
    )


def columns_of(df: DataFrame) -> dict[str, Column]:
    """The rule columns that :func:`attach_rules` has added."""
    return {c: F.col(c) for c in ARRAYS + FLAGS if c in df.columns}


# --- shared predicates (P23, P19) -------------------------------------------

def is_blocked(url: Column | str, domains: Column) -> Column:
    return contains_any_of(bare_host(url), domains)


def is_excluded(text: Column | str, patterns: Column) -> Column:
    return contains_any_of(F.lower(col(text)), patterns)


def is_included(text: Column | str, patterns: Column) -> Column:
    """An empty list includes everything."""
    return (F.size(patterns) == 0) | contains_any_of(F.lower(col(text)), patterns)


def in_sections(section: Column | str, sections: Column) -> Column:
    return contains_any_of(F.lower(col(section)), sections)


def is_trusted(href: Column | str, section: Column | str, allowed: Column, exempt: Column) -> Column:
    """The link leads to an allowed host, or the section needs none."""
    h = F.lower(F.coalesce(col(href), F.lit("")))
    return (
        (F.size(allowed) == 0)
        | let(h, lambda x: F.exists(allowed, lambda d: F.contains(x, d)))
        | F.array_contains(exempt, F.lower(col(section)))
    )


# --- capabilities and merging -----------------------------------------------

def has_capability(capabilities: Column | str, name: str) -> Column:
    """P29."""
    return F.coalesce(F.try_element_at(col(capabilities), F.lit(name)), F.lit(False))


def enabled_capabilities(capabilities: Column | str) -> Column:
    """Names of the enabled capabilities, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(col(capabilities), lambda k, v: v)))


def merge_maps(base: Column, override: Column) -> Column:
    """Entries of ``override`` win."""
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(rest, override)


def add_domains(domains: Column, extra: Column) -> Column:
    """U4: union of two lists without repeats."""
    return F.array_union(domains, extra)
