"""Operator 9, benchmark decontamination: a distributed positional inverted index of the documents.

The index lists, for each term of the benchmark, where it stands in the documents: term, document,
position.  A phrase (window of an item) is looked up from its rarest terms: the offset-adjusted
lists of the two rarest (the postings' positions minus the term's place in the phrase) are
intersected, and what is left is compared word by word with the documents themselves.  All of it
is DataFrame operations.

Documents are told apart by two hashes of id and text, so repeated rows share their postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus.llm.common import settle
from treecensus.operators.joins import fits_broadcast

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case (a text of ASCII alone takes the quick way); null has none."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"),
                            F.xxhash64("text", F.lit("second"), "doc_id").alias("k2"))


def checked(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if it measures small."""
    return F.broadcast(rows) if fits_broadcast(rows) else rows


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, words) of items and the items of each (window, item_id).

    A window is ``size`` consecutive words; an item with fewer words, but not none, is one window.
    """
    parts = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0).select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))),
                                         lambda i: F.slice("w", i + 1, size))).alias("words"))
    own = settle(parts.withColumn("window", F.xxhash64("words")).distinct(), "windows")
    return own.select("window", "words").distinct(), own.select("window", "item_id").distinct()


def index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Written postings (term, k1, k2, pos) of the given terms (hashes of words) in all documents."""
    found = (keyed(documents).select(*KEYS, F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
             .select(F.xxhash64("word").alias("term"), *KEYS, "pos"))
    return settle(found.join(checked(terms), "term", "left_semi"), "postings")


def probes(phrases: DataFrame, postings: DataFrame, lists: int = 2) -> DataFrame:
    """The ``lists`` rarest terms of each window that can occur: window, size, rank, term, place.

    Windows with a term that no document has are left out, since they occur nowhere.
    """
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = phrases.select("window", F.size("words").alias("size"), F.posexplode("words").alias("place", "word")).select(
        "window", "size", "place", F.xxhash64("word").alias("term"))
    rare = Window.partitionBy("window").orderBy("n", "place")
    return settle(terms.join(counts, "term", "left")
                  .withColumn("rank", F.row_number().over(rare)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("window")))
                  .where((F.col("rank") <= lists) & (F.col("least") > 0)).drop("n", "least"), "probes")


def phrase_matches(documents: DataFrame, phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """Where windows occur exactly: k1, k2, start, size, window (once for documents that are the same)."""
    asked = probes(phrases, postings)
    lists = (postings.join(checked(asked), "term")
             .select(*KEYS, (F.col("pos") - F.col("place")).alias("start"), "window", "size", "rank").where("start >= 0"))
    both = (lists.groupBy(*KEYS, "start", "window", "size").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
            .where("first = 1 AND (last = 2 OR size = 1)").drop("first", "last"))
    likely = settle(both.join(checked(settle(phrases, "phrases")), "window"), "likely")
    where = settle(likely.select(*KEYS).distinct(), "likely-documents")
    texts = (keyed(documents).join(checked(where), KEYS, "left_semi").dropDuplicates(KEYS)
             .select(*KEYS, words_of(F.col("text")).alias("all")))
    return (texts.join(likely, KEYS).where(F.slice("all", F.col("start") + 1, F.col("size")) == F.col("words"))
            .select(*KEYS, "start", "size", "window"))


def near_matches(phrases: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Proximity: where the two rarest terms of a window stand within ``slop`` of their distance in it.

    Rows: k1, k2, start (by the rarest term), window, moved (by how much the second is off).
    Positions meet by equal bins of the slop's width and the two beside them.
    """
    asked = probes(phrases, postings)
    width = slop + 1
    lists = (postings.join(checked(asked), "term")
             .select(*KEYS, (F.col("pos") - F.col("place")).alias("start"), "window", "rank")
             .withColumn("bin", F.floor(F.col("start") / width)))
    first = lists.where("rank = 1").drop("rank")
    second = (lists.where("rank = 2").select(*KEYS, "window", F.col("start").alias("other"),
                                             F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("bin")))
    return (first.join(second, [*KEYS, "window", "bin"]).withColumn("moved", F.col("other") - F.col("start"))
            .where(F.abs("moved") <= slop).select(*KEYS, "start", "window", "moved").distinct())


def contamination(documents: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, n_items, items, contaminated.

    A word is hit if it lies inside an occurrence of a window.  ``items`` lists the ids of the
    items with occurring windows, as sorted strings.  A document is contaminated if it has a hit
    and hits make at least one in ``share`` of its words.  Null texts have no words; items that
    are null or without words match nothing; an item without an id marks words but is not listed.
    """
    phrases, owners = windows(items, size)
    terms = settle(phrases.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct(), "terms")
    postings = index(documents, terms)
    matches = settle(phrase_matches(documents, phrases, postings), "matches")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy(*KEYS).orderBy("start", "size", "window").rowsBetween(Window.unboundedPreceding, -1))
    hits = (matches.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
            .groupBy(*KEYS).agg(F.sum("fresh").alias("n_hit")))
    named = (matches.select(*KEYS, "window").distinct().join(checked(settle(owners, "owners")), "window")
             .select(*KEYS, F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy(*KEYS).agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = settle(hits.join(named, KEYS, "left"), "hits")
    rows = keyed(documents).select("doc_id", *KEYS, F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return (rows.join(checked(found), KEYS, "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("items", none).alias("items"))
            .withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
