"""The corpus pipeline: every stage takes the documents its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.llm.catalog import held_out
from pagewell.llm.located import place, stored
from pagewell.llm.mixing import mix_sources
from pagewell.llm.packing import pack_documents
from pagewell.llm.quality import fit_rules
from pagewell.llm.simhash import simhash_groups
from pagewell.llm.streaming_dedup import exact_duplicates
from pagewell.session import stage

# The stages train a model, hash words and draw at random, which SQL cannot repeat.
ORACLE_SQL = None


def _with_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` (a plain scan), whole rows as the struct ``doc``, joined with ``rows`` by ``place``."""
    return docs.select(F.struct("*").alias("doc"), place().alias("place")).join(rows, "place", how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 stay; the held-out labels are not learned from."""
    model = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~held_out())
    return docs.where(model.score(F.col("text")) >= 0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    docs, _ = stored(docs)
    kept = exact_duplicates(spark, docs).where("kept").select(F.col("at").alias("place"))
    return _with_rows(docs, kept, "left_semi").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (null first)."""
    docs, _ = stored(docs)
    known = docs.select(F.struct("doc_id", place().alias("place")).alias("known"), "text")
    kept = simhash_groups(known, id_col="known").where("known = component_id")
    return _with_rows(docs, kept.select("known.place"), "left_semi").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, whole, shard by shard in their shuffled order; a second lap repeats them."""
    docs, _ = stored(docs)
    known = docs.select(place().alias("place"), "doc_id", "text", "source")
    draws = mix_sources(known, cut=False, id_col="place", order_col="doc_id")
    draws = draws.select("place", F.explode("draws").alias("draw"))
    mixed = _with_rows(docs, draws, "inner")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        mixed.repartition(parts, F.col("draw.shard"), F.pmod(F.col("draw.place"), F.lit(16)))
        .sortWithinPartitions("draw.shard", "draw.place")
        .select("doc.*")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and places in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
