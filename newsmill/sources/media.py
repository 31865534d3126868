"""Media catalogue: D16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def media_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Audio files below a folder, from file metadata alone; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{mp3,wav}")
        .load(root)
        .select("path", "modificationTime", "length")
    )
    parts = F.split("path", "/")
    return files.select(
        F.replace("path", F.concat(F.regexp_extract("path", "^(file:)?", 0), F.lit(root.rstrip("/") + "/")), F.lit("")).alias("path"),
        F.element_at(parts, -2).alias("week"),
        F.element_at(parts, -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
