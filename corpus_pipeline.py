"""A corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes every stage's
result below the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from treecensus.llm import decontamination, language, near_duplicates, packing, pii
from treecensus.llm.common import folder, importable, settle, table

#: Documents stranger than this to all learnt languages are rejected, as are those without a letter.
STRANGEST = 1.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = "_carried"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language. The network learns from the stage's own labelled rows.

    If no row is labelled nothing can be recognised, and only documents without letters go.
    """
    network = language.fit(docs, ~language.held_out(F.col("doc_id")))
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = [f"`{c}`" for c in docs.columns]
    found = language.predict(docs.select(*columns, F.lit(0).alias("_row")), network)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("strangeness") <= STRANGEST)).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the one with the smallest doc_id, then by hash.

    Groups are found on a key of id and text, so different texts under one doc_id are told apart, and rows
    without a doc_id are in groups like all others (after those with one). Texts without words are
    alike only under the same doc_id.
    """
    named = docs.withColumn("_key", F.xxhash64("doc_id", "text")).withColumn("_hash", F.xxhash64(*(f"`{c}`" for c in docs.columns)))
    found = near_duplicates.near_duplicates(named.select(F.col("_key").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_hash")
    first = named.groupBy("_key").agg(F.min(order).alias("least"))
    kept = groups.join(first, "_key").groupBy("component_id").agg(F.min("least").alias("least")).select("least._key", "least._hash")
    return named.join(kept, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Rows without a doc_id are judged by their text."""
    named = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = decontamination.contamination(
        docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return named.join(bad, "_key", "left_anti").select(*docs.columns)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(pii.find(docs))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
                            .cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences of 2048 tokens."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    kept = settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(kept).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _ready(stage):
    """A stage that leaves all but the columns of ``documents`` alone: they are carried as one struct.

    So no name of an extra column can meet a working name of an operator, in whatever case it is written.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        extra = [c for c in docs.columns if c not in COLUMNS]
        if not extra:
            return stage(spark, docs, sf_dir)
        # names inside the struct are numbers, since an operator may write its type as text
        held = F.struct(*(F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(extra))).alias(CARRIED)
        done = stage(spark, docs.select(*(c for c in docs.columns if c in COLUMNS), held), sf_dir)
        if CARRIED not in done.columns:
            return done
        return done.select(*(F.col(CARRIED)[f"c{extra.index(c)}"].alias(c) if c in extra else F.col(c) for c in docs.columns))
    return run_stage


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


STAGES = [("language_id", _ready(language_id)), ("near_dedup", _ready(near_dedup)), ("decontaminate", _ready(decontaminate)),
          ("remove_pii", _ready(remove_pii)), ("pack", _ready(pack))]

#: Trained networks and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
