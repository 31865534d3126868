"""Registries, rule sets, URL lists and tables: S1, S13, S16, S23."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.functions.arrays import first_present
from newsmill.functions.urls import source_type
from newsmill.schemas import RULE, SOURCE
from newsmill.operators.rows import unnest


def parse_registry(texts: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Sources from registry documents: a list or ``{"sources": [...]}`` of objects or URLs.

    ``keep``: columns that tell which document a source is from."""
    t = F.trim(F.col(text))
    listed = F.when(F.startswith(t, F.lit("[")), t).otherwise(F.get_json_object(t, "$.sources"))
    entry = unnest(texts, F.from_json(listed, "array<string>"), "entry", "pos", *keep)
    record = F.from_json("entry", SOURCE)
    is_object = F.startswith(F.trim("entry"), F.lit("{"))
    url = F.when(is_object, record["url"]).otherwise(F.col("entry"))
    return entry.select(
        *keep,
        "pos",
        url.alias("url"),
        F.coalesce(record["enabled"], F.lit(True)).alias("enabled"),
        first_present(record["type"], source_type(url)).alias("type"),
        *[F.when(is_object, record[c]).alias(c) for c in ("name", "selector", "config")],
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a URL file that are neither blank nor comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where(
        (F.col("url") != "") & ~F.startswith("url", F.lit("#"))
    )


def read_http_urls(spark: SparkSession, path: str) -> DataFrame:
    """Lines that start with ``http``."""
    return read_urls(spark, path).where(F.startswith("url", F.lit("http")))


def read_sources(
    spark: SparkSession, path: str | None, fallback: str | None = None, enabled_only: bool = True
) -> DataFrame:
    """The registry; if it yields nothing, the fallback file of video channel URLs."""
    found = None
    if path:
        found = parse_registry(spark.read.text(path, wholetext=True)).drop("pos")
    if fallback and (found is None or found.isEmpty()):
        found = read_urls(spark, fallback).select(
            "url", F.lit(True).alias("enabled"), F.lit("youtube").alias("type"),
            *[F.lit(None).cast("string").alias(c) for c in ("name", "selector", "config")],
        )
    if found is None:
        return spark.createDataFrame([], SOURCE)
    return found.where("enabled") if enabled_only else found


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON rule sets; names come from the files, ``_`` files are skipped."""
    raw = (
        spark.read.option("multiLine", True).schema(RULE).json(path)
        .withColumn("file", F.col("_metadata.file_name"))
        .where(~F.startswith("file", F.lit("_")))
        .withColumn("rule_set", F.regexp_replace("file", r"\.json$", ""))
        .withColumn("display_name", first_present(F.col("name"), F.col("rule_set")))
    )
    return raw.withColumn("name", F.col("rule_set")).withColumn("rule_order", F.col("rule_set")).drop("file")


def resolve_table(names: Sequence[str], wanted: str) -> str | None:
    """The exact name, else the only table there is, else none."""
    if wanted in names:
        return wanted
    return names[0] if len(names) == 1 else None


def read_target(spark: SparkSession, wanted: str, database: str = "default") -> DataFrame | None:
    """A catalog table by name."""
    names = [t.name for t in spark.catalog.listTables(database)]
    found = resolve_table(names, wanted)
    return spark.table(f"{database}.{found}") if found else None
