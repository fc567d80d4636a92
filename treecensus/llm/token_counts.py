"""Operator 1, token counts: pieces are counted once for each distinct pre-token.

Texts become pre-token frequencies; the number of pieces of a distinct pre-token is found once
in a table of its own; documents are joined to that table and sum frequency times pieces.  No
token ids of documents are ever made.

Skew: word frequencies are.  The ``frequent`` most frequent pre-tokens (a documented bound, not
a cap: it decides only how a word is joined) go to the tasks as a dictionary of that size at
most, and meet the frequencies while texts are read.  All rarer ones are joined by a shuffle, in
which no key can hold more than one in ``frequent`` of all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecensus.llm.common import pieces_of, settle
from treecensus.llm.tokens import encoder

FREQUENT = 1 << 17
MOST_HELD = 300_000
LIMIT = 2048


def word_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) over all texts; each task adds up what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(tokenizer), Counter()

        def out():
            words = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

        for batch in pieces_of(batches):
            for text in batch.column(0):
                for part in coder.parts(text.as_py() or "")[::2]:
                    seen.update(coder.split(part))
            if len(seen) > MOST_HELD:
                yield out()
                seen.clear()
        yield out()

    found = documents.select("text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def word_pieces(words: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``pieces``, the number of tokens of a pre-token, to distinct pre-tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            sizes = [len(coder.ids_of(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], ["word", "n", "pieces"])

    return words.select("word", "n").mapInArrow(pieces, "word string, n bigint, pieces bigint")


def token_counts(documents: DataFrame, tokenizer: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one: 0 bytes, 0 tokens.  Repeated rows and rows without a
    doc_id each get a row.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = documents.sparkSession
    pieces = settle(word_pieces(word_counts(documents, tokenizer), tokenizer), "pieces")
    top = pieces.orderBy(F.desc("n"), "word").limit(frequent).select("word", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), top["pieces"].to_pylist())))
    rare = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(tokenizer), known.value
        for batch in pieces_of(batches):
            sums, ends, words, counts = [], [0], [], []
            for text in batch.column("text"):
                parts = coder.parts(text.as_py() or "")
                total, own = len(parts) // 2, Counter()
                for part in parts[::2]:
                    own.update(coder.split(part))
                for word, n in own.items():
                    size = table.get(word)
                    if size is None:
                        words.append(word)
                        counts.append(n)
                    else:
                        total += n * size
                sums.append(total)
                ends.append(len(words))
            left = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], fields=list(rare))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left)],
                ["row", "doc_id", "n_bytes", "known", "rare"])

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    read = settle(rows.mapInArrow(
        frequencies, f"row bigint, doc_id {kind}, n_bytes bigint, known bigint, rare array<struct<word:string,n:bigint>>"),
        "frequencies")
    rest = (read.select("row", F.inline("rare")).join(pieces.select("word", "pieces"), "word")
            .select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("n_bytes"),
                    (F.col("n") * F.col("pieces")).alias("tokens")))
    whole = read.select("row", "doc_id", "n_bytes", F.col("known").alias("tokens")).unionByName(rest)
    return (whole.groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
