"""Processed-id state: S18, D11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsmill import fixed
from newsmill.operators.schedule import live_ids
from newsmill.schemas import STATE

_DOCUMENT = "struct<version:int, videos:map<string,struct<processed_date:string,title:string>>>"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def parse_state(texts: DataFrame, text: str = "value") -> DataFrame:
    """Ids of state documents; a corrupt or wrongly shaped document holds none."""
    doc = F.from_json(F.col(text), _DOCUMENT, {"mode": "PERMISSIVE"})
    return texts.select(F.explode(doc["videos"]).alias("id", "v")).select(
        "id", F.col("v.processed_date").alias("processed_date"), F.col("v.title").alias("title")
    )


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def load_document(spark: SparkSession, path: str | None) -> DataFrame:
    """State from a JSON document; empty when there is none."""
    if not path:
        return empty_state(spark)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return empty_state(spark)
    return parse_state(spark.read.text(path, wholetext=True))


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
            out.append(int(name[1:]))
    return sorted(out)


def load_state(spark: SparkSession, base: str | None) -> DataFrame:
    """The newest complete version of a state table."""
    versions = _versions(spark, base) if base else []
    if not versions:
        return empty_state(spark)
    return spark.read.schema(STATE).parquet(f"{base}/v{versions[-1]}")


def save_state(
    state: DataFrame | None, base: str | None, as_of: Column, days: int = fixed.STATE_TTL_DAYS
) -> None:
    """Write the live ids as a new version; readers switch when it is complete."""
    if state is None or not base:
        return
    spark = state.sparkSession
    versions = _versions(spark, base)
    version = (versions[-1] if versions else 0) + 1
    live_ids(state, as_of, days).select("id", "processed_date", "title").write.parquet(f"{base}/v{version}")


def mark_processed(state: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The state with more ids, dated ``as_of``; the later date of an id stays."""
    fresh = ids.select(
        "id", F.date_format(as_of, "yyyy-MM-dd").alias("processed_date"), F.lit(None).cast("string").alias("title")
    )
    both = state.unionByName(fresh)
    return both.groupBy("id").agg(
        F.max("processed_date").alias("processed_date"), F.max("title").alias("title")
    )
