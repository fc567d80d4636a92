"""The pipeline's stages on a small table, against what each operator says."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treecensus.llm import decontamination, near_duplicates, pii

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, docs = docs.columns, docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        if name != "pack":
            assert got.columns == columns
            got = got.cache()
        if name == "near_dedup":
            kept = near_duplicates.near_duplicates(docs).where("kept").select("doc_id")
            assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in kept.collect())
        if name == "decontaminate":
            found = decontamination.contamination(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert got.count() == found.where("NOT contaminated").count() < docs.count()
        if name == "remove_pii":
            assert got.count() == docs.count() and pii.find(got).where(F.size("spans") > 0).count() == 0
            assert got.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
        if name == "pack":
            assert got.select("doc_id").distinct().count() == docs.count()
        docs = got


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontaminate", "remove_pii", "pack"])
def test_stage_on_nothing_and_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    like = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert stage(spark, like.limit(0), FOLDER).count() == 0
    odd = spark.createDataFrame([(1, "some words here", None, None, None), (1, "some words here", None, None, None),
                                 (None, "other words there", None, None, 3), (2, None, None, "s", 0)], like.schema)
    got = stage(spark, odd, FOLDER)
    rows = got.select("doc_id").collect()
    assert len(rows) == {"language_id": 3, "near_dedup": 3, "decontaminate": 4, "remove_pii": 4, "pack": 4}[name]


def test_near_dedup_keeps_each_text_of_a_repeated_id_and_one_of_copies_without_id(spark):
    like = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    say = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, say("a"), "en", "s", 1), (1, say("b"), "en", "s", 1), (1, say("b"), "de", "s", 1), (2, say("b") + " more", "en", "s", 1),
            (None, say("a"), "en", "s", 1), (None, say("c"), "en", "s", 1), (None, say("c"), "en", "s", 1), (3, None, None, None, None)]
    runs = []
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, like).repartition(3)
        runs.append(sorted(map(tuple, corpus_pipeline.near_dedup(spark, table, FOLDER).collect()), key=repr))
    assert runs[0] == runs[1]
    want = [(1, say("a")), (1, say("b")), (3, None), (None, say("c"))]
    assert sorted(((r[0], r[1]) for r in runs[0]), key=repr) == sorted(want, key=repr)


# working names of the stages and operators, in both cases, and names that have to be quoted
CLASHING = ["_row", "lang_pred", "Score", "_key", "_HASH", "spans", "_m0", "_G1", "_s2", "component_id", "kept", "least", "idx",
            "_carried", "c0", "piece", "start", "ids", "a b.c", "tick`s"]


def test_extra_columns_of_any_name_come_through_every_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wide = docs.select(F.struct(F.col("doc_id")).alias("spread"), *docs.columns, *(
        F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASHING)).cache()
    for name, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs, FOLDER)
        got = stage(spark, wide, FOLDER)
        if name == "pack":
            assert got.columns == plain.columns and got.count() == plain.count()
            continue
        assert got.columns == wide.columns
        rows = got.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
        for r in rows:
            assert r["spread"]["doc_id"] == r["doc_id"] and all(r[c] == f"{c}:{r['doc_id']}" for c in CLASHING)


def test_language_id_rejects_an_unlearnt_language_and_keeps_the_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unlabelled = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    cyrillic = docs.where("doc_id % 5 = 0").select(
        (F.col("doc_id") + 10**9).alias("doc_id"), F.translate(
            F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхызы").alias("text"),
        F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = {r.doc_id for r in stage(spark, unlabelled.unionByName(cyrillic), "").select("doc_id").collect()}
    rows = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").collect()
    share = lambda ids: sum(i in kept for i in ids) / len(ids)
    assert share([r.doc_id for r in rows if r.lang != "es"]) >= 0.99
    assert share([r.doc_id for r in rows if r.lang == "es"]) <= 0.1
    assert share([r.doc_id for r in cyrillic.select("doc_id").collect()]) <= 0.1
