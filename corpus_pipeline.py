"""The corpus pipeline: documents in, a weighted training mixture out.

Each stage takes what the one before kept, written as Parquet and read again.  All but the
last return the columns of ``documents``; its n_chars follows the text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm import decontaminate, near_copies, site_spread, toxicity
from newsmill.llm.common import table, text_key
from newsmill.llm.queries import LEVELS, mixture
from newsmill.session import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(F.coalesce(toxicity.toxicity(model)("text"), F.lit(0.0)) < 0.5)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on ten sources or more; no document goes."""
    out = site_spread.remove_boilerplate(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of those with equal keys, null being a key, the one of the least hash.

    Keys are counted first, without texts; only rows whose keys stand several times move."""
    several = durable(rows.groupBy(*keys).count().where("count > 1").drop("count"), "repeated")
    if several.isEmpty():
        return rows
    again = several.alias("s")
    same = reduce(and_, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    others = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*others), F.xxhash64(*others)).alias("least")
    once = rows.alias("r").join(again, same, "left_semi").groupBy(*keys).agg(least).select(*keys, "least.*")
    return rows.alias("r").join(again, same, "left_anti").unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles at similarity 0.8 or more) the document
    with the least id, and of rows with equal id and text one.

    SimHashes are linked through BK-trees first, as in op4; MinHash buckets find the pairs at 0.8
    whose SimHashes lie further apart.  Every link is verified on the whole texts.

    Rows of one id with different texts stay or go together.  Rows without an id are compared
    with nothing but each other, and only whole: of those with one text, one stays."""
    groups = near_copies.near_copies(docs)
    kept = docs.join(durable(groups.where("doc_id != component_id").select("doc_id"), "copies"), "doc_id", "left_anti")
    rows = kept.select(*text_key(F.col("doc_id"), F.col("text")), F.struct(*docs.columns).alias("row"))
    return one_of_each(rows, ["_id", "_hash"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and epoch with its text, n_tokens and taken (the first
    tokens that count).

    Repeated rows count as often as they stand: k equal rows give up to k rows an epoch.  Where
    ``docs`` has a column domain, epoch, n_tokens or taken, the one of the mixture takes its
    place."""
    added = ["domain", "epoch", "n_tokens", "taken"]
    own = [c for c in docs.columns if c not in added]
    keys = ["_id", "_hash", *[f"_{name}" for name in LEVELS]]
    leaf = [F.coalesce(level().cast("string"), F.lit("")).alias(f"_{name}") for name, level in LEVELS.items()]
    chosen = mixture(docs).select("_id", "_hash", *[F.col(name).alias(f"_{name}") for name in LEVELS], *added)
    rows = docs.select(*text_key(F.col("doc_id"), F.col("text")), *leaf, F.struct(*own).alias("row"))
    return one_of_each(rows, keys).join(durable(chosen, "chosen"), keys).select("row.*", *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", weigh),
]

# Classifier, fingerprints and edit distances have no SQL form; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
