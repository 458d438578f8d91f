"""From documents to packed sequences: language ID, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents (the
last one: pieces). Each result is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import exact_dedup, language_id, mixing, near_dedup, packing
from glimmer.llm.common import new_path, numbered, pick_rows, small, stage, table

#: Words that a worker remembers while it packs; it lets go of them after each task, since workers live on.
CACHE_ENTRIES = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (or null) are rejected, and no others, whatever was predicted for them.

    Null lang is filled with the prediction and a given one stays; where no row has a label, lang stays null.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs)
    told = docs.withColumn("_p", language_id.predict_language(F.col("text"), model)).where("_p.lettered")
    return told.withColumn("lang", F.coalesce("lang", "_p.lang_pred") if model.langs else F.col("lang")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs as one space) one row stays: the smallest doc_id's, null last, then the first in the files."""
    return exact_dedup.drop_duplicates(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 over 5-word shingles one stays: the smallest doc_id's, null last, then the first in the files.

    Rows go by their number, since a doc_id may be null or stand for several texts.
    """
    docs = numbered(docs.select(*COLUMNS), "near-input", "_row")
    found = near_dedup.near_components(docs.select(F.col("_row").alias("doc_id"), "text"), size=5, percent=80)
    linked = stage(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_in")), "near-linked-rows")
    every = stage(linked.unionByName(linked.select(F.col("_in").alias("_row"), "_in").distinct()), "near-linked-rows")
    named = stage(docs.select("_row", F.col("doc_id").cast("long").alias("_id")).join(small(every), "_row"), "near-named-rows")  # no texts
    keeps = named.groupBy("_in").agg(F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_row")).alias("k")).select("_in", F.col("k._row").alias("_stays"))
    go = stage(named.join(small(stage(keeps, "near-keeps")), "_in").where(F.col("_row") != F.col("_stays")).select("_row"), "near-go")
    return pick_rows(docs, "_row", go, keep=False).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture; the written files keep it."""
    return mixing.in_mixed_order(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens; groups of consecutive documents of the mixture are packed together, and
    sequence_id ascends with the mixture from group to group."""
    docs = packing.with_ordered_buckets(docs.select("doc_id", "text"), "_bucket")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, bucket=F.col("_bucket"), cache_entries=CACHE_ENTRIES, in_order=True, forget=True)


STAGES = [("language_id", identify_languages), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: The order of the mixture and the merge table of the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
