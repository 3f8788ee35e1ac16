"""Documents from raw to mixed: five stages, each over all rows the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigie.llm import decontaminate, mixing, repeats, simhash, toxicity
from vigie.llm.tables import given
from vigie.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Learning, chains of links and rounding have no SQL form; tests hold the rows against plain code.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    labels = given(spark, sf_dir, "labels", "doc_id", "toxic")
    return docs.filter(toxicity.score_of("text", toxicity.learned(docs, labels)) < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the long passages that occur elsewhere, too; ``n_chars`` follows."""
    kept = repeats.cut_repeats(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a test item."""
    return decontaminate.remove_contamination(docs, given(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its text as the stages before left it, and what the mix takes of it; 0 is left out."""
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    mixed = mixing.mix(rows.select("doc.doc_id", "doc.text", "doc.source", "row"), carry="row")
    taken = mixed.select(F.col("row").alias("number"), "size", "source_size", "target", "copies", "taken")
    found = rows.join(taken, F.col("row") == F.col("number"))
    added = [name for name in taken.columns if name != "number"]
    return found.select(*[F.col(f"doc.{name}") for name in docs.columns if name not in added], *added)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_to_target_weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next."""
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
