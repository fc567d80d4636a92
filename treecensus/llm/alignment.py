"""Operator 11, alignment of two tokenizers: how often each pair of their token ids is linked over all documents.

Byte offsets where tokens of both end cut them into groups; every token of A in a group is linked to
every token of B in it.  One pass over the texts aligns the documents and writes their distinct pairs;
these are counted: for each id pair, the documents that hold it linked.  The distinct pairs get a minimal perfect hash (``hashing``), in slices
of bounded size; counts are dense vectors, one number for each place of a slice.  Every task's counts
become such vectors, which are summed in a tree.  The keys are stored by place as well, so a lookup is
verified.  At last the written pairs are looked up, so no text is encoded twice.

B takes most time where it encodes what it has met before.  Texts without odd white space are cut for
it before spaces and line ends, which no piece crosses, and each distinct part is encoded once by a
worker, which forgets them when they are more than ``MOST_KEPT``.  Other texts are encoded whole.

A text that is null or empty, or that either tokenizer does not give back byte for byte (one with
U+2581, which B takes for a space), has no tokens: zeros and an empty digest.  Repeated rows, and rows
without a doc_id, are documents like all others, each counted.  Other columns are not read.  An empty
table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from treecensus.llm.common import pieces_of, settle
from treecensus.llm.hashing import PerfectHash
from treecensus.llm.tokens import PLAIN, SPACED, Encoder, byte_letters

#: Keys of a slice, about.
SLICE = 1 << 16
#: Counted rows that one task adds up in a slice; vectors that one task adds up on the next level.
BRANCH, FAN = 1 << 18, 8
#: With up to so many pairs, every worker is sent all of them (16 bytes each); else documents' pairs are sent to the slices.
KNOWN = 2_000_000
MOST_KEPT = 1_000_000
#: Counts a task holds before it hands them on.
HELD = 1 << 20
#: White space after a space or a line end; a text of plain characters with one of these is odd.
_ODD = [x + y for x in " \n" for y in " \n\t\r\xa0"]
#: A group with more links than these is counted by its distinct tokens.
LARGE = 4096
RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BASE = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class Table:
    """The bytes of each token id."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.flat[np.arange(n.sum()) + np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)]


class Aligned:
    """Some documents' tokens, one document after the other: ids, the tokens of each group, and where documents begin."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        """``ends`` are byte offsets over all documents, whose tokens end where the document ends."""
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        marked = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, bool)
        marked[ends_b] = True
        last_a = marked[ends_a]
        marked[ends_b] = False
        marked[ends_a] = True
        last_b = marked[ends_b]
        self.last_a, self.last_b = last_a, last_b
        stops_a, stops_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        self.x, self.y = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        self.stops_a, self.stops_b = stops_a, stops_b
        self.groups = _per(last_a, n_a)
        self.links = summed(self.x * self.y, self.groups)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each document: document, key, times linked."""
        doc = np.repeat(np.arange(len(self.groups)), self.groups)
        few = self.x * self.y <= LARGE
        of_a = np.repeat(np.arange(len(self.x)), self.x)  # the group of each token of A
        at = np.flatnonzero(few[of_a])
        group = of_a[at]
        n = self.y[group]
        other = np.arange(n.sum()) + np.repeat(self.stops_b[group] - self.y[group] - (np.cumsum(n) - n), n)
        both = [doc[np.repeat(group, n)] << 32 | self.a[np.repeat(at, n)] << 16 | self.b[other]]
        times = [np.ones(len(other), np.int64)]
        for g in np.flatnonzero(~few):
            i, p = np.unique(self.a[self.stops_a[g] - self.x[g]:self.stops_a[g]], return_counts=True)
            j, q = np.unique(self.b[self.stops_b[g] - self.y[g]:self.stops_b[g]], return_counts=True)
            both.append((doc[g] << 32 | i[:, None] << 16 | j).ravel())
            times.append((p[:, None] * q).ravel())
        each, counts = merged(np.concatenate(both), np.concatenate(times))
        return each >> 32, each & 0xFFFFFFFF, counts

    def digests(self, shown: list[str]) -> list[str]:
        """The digest of each document's groups; ``shown`` has the text of each id with the sign after it."""
        before_b, before_a = np.repeat(self.stops_b - self.y, self.x), np.repeat(self.stops_a, self.y)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b] = self.a | self.last_a << 16  # , and |
        codes[np.arange(len(self.b)) + before_a] = self.b | np.where(self.last_b, 2 << 16, 0)  # , and ;
        ends, out = np.cumsum(self.n_a + self.n_b).tolist(), []
        for end, n in zip(ends, (self.n_a + self.n_b).tolist()):
            text = "".join(map(shown.__getitem__, codes[end - n:end].tolist()))
            out.append(sha256(text[:-1].encode()).hexdigest() if n else "")
        return out


def odd(text: str) -> bool:
    """Whether a text has to be encoded whole."""
    return not PLAIN.fullmatch(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD)


def _per(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each stretch are marked."""
    return summed(marks.astype(np.int64), sizes)


class Aligner:
    """Both tokenizers, and the ids of B of the parts met so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        if self.a.lower or self.a.pattern is not SPACED:
            raise ValueError(f"{path_a} is not a byte-level vocabulary")
        self.a.library.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.library.get_vocab()
        raw_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            raw_a[i] = b"" if piece in self.a.special else bytes(letters[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", piece) for piece in pieces) or max(len(pieces), len(raw_a)) > 1 << 16:
            raise ValueError(f"{path_b} has pieces over a space or a line end, or too many")
        self.raw_a = Table(raw_a)
        self.raw_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.shown = [f"{i}{sign}" for sign in ",|;" for i in range(1 << 16)]
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        #: The ids of all parts after each other, and where the parts begin.
        self.flat = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        #: Whether a part's ids give other bytes than its own.
        self.broken = np.zeros(0, bool)

    def ids_a(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.a.kept.__getitem__, SPACED.findall(text)))
        return np.asarray(self.a.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: list[str], whole: bool = False) -> int:
        """Add parts, or whole texts; gives the number of the first one."""
        first = len(self.starts[0]) - 1
        # a part after a line end has no space before it; the one that B's library adds is a piece of its own
        bare = [part.startswith("\n") and not whole for part in parts]
        left = [self.ids_a(part if b else " " + part) for part, b in zip(parts, bare)]
        right = [ids[1:] if b else ids for ids, b in zip(self.b.encode(parts, num_threads=1), bare)]
        sizes = [len(ids) // 4 for ids in left], [len(ids) for ids in right]
        added = np.frombuffer(b"".join(left), "<u4"), np.fromiter(chain.from_iterable(right), np.uint16, sum(sizes[1]))
        raw = [(part if b else " " + part).encode() for part, b in zip(parts, bare)]
        size, whole_bytes = np.array([len(r) for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
        broken = np.zeros(len(parts), bool)
        for table, ids, n in ((self.raw_a, added[0], sizes[0]), (self.raw_b, added[1], sizes[1])):
            n = np.array(n, np.int64)
            same = summed(table.sizes[ids], n) == size
            differ = table.bytes_of(ids[np.repeat(same, n)]) != whole_bytes[np.repeat(same, size)]
            same[same] = _per(differ, size[same]) == 0
            broken |= ~same
        self.broken = np.concatenate([self.broken, broken])
        for i in range(2):
            self.flat[i] = np.concatenate([self.flat[i], added[i].astype(np.uint16)])
            self.starts[i] = np.concatenate([self.starts[i], self.starts[i][-1] + np.cumsum(sizes[i], dtype=np.int64)])
        return first

    def tokens(self, i: int, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the i-th tokenizer of so many parts a text, and their number for each text."""
        n = self.starts[i][parts + 1] - self.starts[i][parts]
        at = np.arange(n.sum()) + np.repeat(self.starts[i][parts] - (np.cumsum(n) - n), n)
        return self.flat[i][at].astype(np.int64), summed(n, sizes)

    def documents(self, texts: list[str | None]) -> Aligned:
        """All texts; those that are not given back byte for byte have no tokens."""
        if len(self.index) > MOST_KEPT or len(self.flat[0]) > 8 * MOST_KEPT:
            self.forget()
        given = [text or "" for text in texts]
        whole = {i for i, text in enumerate(given) if text and odd(text)}
        cut = [[] if not text or i in whole else text.replace("\n", " \n").split(" ") for i, text in enumerate(given)]
        sizes = np.array([len(parts) for parts in cut], np.int64)
        parts = np.fromiter(map(self.index.get, chain.from_iterable(cut), repeat(-1)), np.int64, int(sizes.sum()))
        missing = np.flatnonzero(parts < 0)
        if len(missing):
            unknown = np.zeros(len(parts), bool)
            unknown[missing] = True
            unmet = list(compress(chain.from_iterable(cut), unknown.tolist()))
            new = list(set(unmet))
            first = self.learn(new)
            self.index.update(zip(new, range(first, first + len(new))))
            parts[missing] = np.fromiter(map(self.index.__getitem__, unmet), np.int64, len(unmet))
        if whole:  # not met again
            told = np.split(parts, np.cumsum(sizes)[:-1])
            for i in whole:
                told[i], sizes[i] = np.array([self.learn([given[i]], whole=True)]), 1
            parts = np.concatenate(told)
        bad = _per(self.broken[parts], sizes) > 0
        if bad.any():
            parts, sizes = parts[~np.repeat(bad, sizes)], sizes * ~bad
        (a, n_a), (b, n_b) = (self.tokens(i, parts, sizes) for i in range(2))
        return Aligned(a, b, np.cumsum(self.raw_a.sizes[a]), np.cumsum(self.raw_b.sizes[b]), n_a, n_b)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker; Spark keeps its Python workers between tasks."""
    return Aligner(path_a, path_b)


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many rows."""
    whole = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return whole[ends] - whole[ends - sizes]


def slice_of(key, slices: int):
    """The slice of a key, as a column or in numpy."""
    return key * 1_000_003 % 2_147_483_647 % slices


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(each), np.int64)
    np.add.at(out, back, counts)
    return each, out


def spelt(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The one pass over texts: what is known of a document without counts, and its distinct pairs with how often each is linked."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in pieces_of(batches):
            found = own.documents(batch.column(1).to_pylist())
            doc, keys, times = found.pairs()
            ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            columns = [batch.column(0), *map(pa.array, (found.n_a, found.n_b, found.groups, found.links)),
                       pa.array(found.digests(own.shown), pa.string()), pa.ListArray.from_arrays(ends, pa.array(keys)),
                       pa.ListArray.from_arrays(ends, pa.array(times))]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(spell, f"{BASE}, keys array<bigint>, times array<bigint>")


def counted(known: DataFrame) -> DataFrame:
    """(part, key, n) of written pairs: the documents of a task's stretch that hold the pair linked."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        old: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def tidy() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([np.zeros(0, np.int64), *held])
            held.clear()
            return merged(np.concatenate([old[0], new]), np.concatenate([old[1], np.ones(len(new), np.int64)]))

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(old[0]), task), pa.int64()), *map(pa.array, old)], ["part", "key", "n"])

        for batch in pieces_of(batches):
            held.append(batch.column(0).flatten().to_numpy())
            if sum(map(len, held)) > HELD:
                old = tidy()
                if len(old[0]) > HELD:
                    yield given()
                    old = (old[0][:0], old[1][:0])
        old = tidy()
        yield given()

    return known.select("keys").mapInArrow(count, "part bigint, key bigint, n bigint")


VECTOR = "slice bigint, branch bigint, hash array<binary>, keys binary, counts binary"


def vectors(partial: DataFrame, pairs: DataFrame, many: int) -> DataFrame:
    """(slice, hash, keys, counts): for each slice its perfect hash, and keys and counts by place."""
    slices = max(1, -(-many // SLICE))
    at = slice_of(F.col("key"), slices).alias("slice")

    def hashes(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        perfect = PerfectHash.of(keys)
        ordered = np.empty(len(keys), np.int64)
        ordered[perfect.find(keys)] = keys
        return pa.table({"slice": group.column("slice").slice(0, 1), "hash": pa.array([perfect.stored()], pa.list_(pa.binary())),
                         "keys": pa.array([ordered.tobytes()], pa.binary())})

    made = settle(pairs.select("key", at).groupBy("slice").applyInArrow(hashes, "slice bigint, hash array<binary>, keys binary"), "hashes")
    rows = partial.count()
    branches = max(1, -(-rows // (slices * BRANCH)))

    def add(keys: pa.Table, table: pa.Table) -> pa.Table:
        place = PerfectHash.loaded(table.column("hash")[0].as_py()).find(keys.column("key").to_numpy())
        counts = np.zeros(len(table.column("keys")[0].as_buffer()) // 8, np.int64)
        np.add.at(counts, place, keys.column("n").to_numpy())
        return table.append_column("counts", pa.array([counts.tobytes()], pa.binary())).select(["slice", "branch", "hash", "keys", "counts"])

    def total(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group.column("counts"))
        return group.slice(0, 1).set_column(4, "counts", pa.array([counts.tobytes()], pa.binary()))

    copies = made.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(branches - 1).cast("bigint"))))
    each = partial.select(at, F.pmod(F.xxhash64("part"), F.lit(branches)).cast("bigint").alias("branch"), "key", "n")
    found = each.groupBy("slice", "branch").cogroup(copies.groupBy("slice", "branch")).applyInArrow(
        lambda keys, table: add(keys, table) if keys.num_rows else table.append_column(
            "counts", pa.array([bytes(len(table.column("keys")[0].as_buffer()))], pa.binary())).select(
                ["slice", "branch", "hash", "keys", "counts"]), VECTOR)
    while branches > 1:
        branches = -(-branches // FAN)
        found = found.withColumn("branch", F.floor(F.col("branch") / FAN).cast("bigint")).groupBy("slice", "branch").applyInArrow(total, VECTOR)
    return settle(found.drop("branch"), "vectors")


class Counts:
    """Looks counts up: rows of ``vectors`` by slice, and the highest count of each id of A."""

    def __init__(self, rows: list[tuple[int, list[bytes], bytes, bytes]], slices: int, highest: np.ndarray):
        self.slices, self.highest = slices, highest
        self.known = {s: (PerfectHash.loaded(h), np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for s, h, k, c in rows}

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of keys, and whether they are their A id's highest. A key that is not stored has the count 0."""
        out, at = np.zeros(len(keys), np.int64), slice_of(keys, self.slices)
        for s in np.unique(at):
            mine = np.flatnonzero(at == s)
            if int(s) not in self.known:
                continue
            perfect, stored, counts = self.known[int(s)]
            place = perfect.find(keys[mine])
            met = (place >= 0) & (stored[place] == keys[mine])
            out[mine[met]] = counts[place[met]]
        return out, out == self.highest[keys >> 16]


def highest(found: DataFrame, size: int) -> np.ndarray:
    """The highest count of each id of A: one number for each entry of its vocabulary."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                a = np.frombuffer(keys.as_buffer(), np.int64) >> 16
                most = np.zeros(size, np.int64)
                np.maximum.at(most, a, np.frombuffer(counts.as_buffer(), np.int64))
                met = np.unique(a)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(most[met])], ["a", "n"])

    rows = found.select("keys", "counts").mapInArrow(flat, "a bigint, n bigint").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["a"].to_numpy()] = rows["n"].to_numpy()
    return out


def align(documents: DataFrame, path_a: str, path_b: str, known: int = KNOWN) -> DataFrame:
    """For each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = settle(spelt(documents, path_a, path_b), "spelt")
    partial = settle(counted(rows), "pair-counts")
    pairs = settle(partial.select("key").distinct(), "pairs")
    many = pairs.count()
    found = vectors(partial, pairs, many)
    slices = max(1, -(-many // SLICE))
    most = highest(found, 1 << 16)
    return (_sent if many <= known else _fetched)(rows, found, slices, most)


def _sent(rows: DataFrame, found: DataFrame, slices: int, most: np.ndarray) -> DataFrame:
    """All counts, ``known`` at most, are sent to every worker."""
    shared = rows.sparkSession.sparkContext.broadcast((
        [(r["slice"], [bytes(b) for b in r["hash"]], bytes(r["keys"]), bytes(r["counts"])) for r in found.collect()], slices, most))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        for batch in pieces_of(batches):
            *facts, keys, times = batch.columns
            sizes, times = keys.value_lengths().to_numpy(), times.flatten().to_numpy()
            each, back = np.unique(keys.flatten().to_numpy(), return_inverse=True)
            n, best = (found[back] for found in counts.of(each))
            columns = [*facts, pa.array(summed(best * times, sizes)), pa.array(summed(n * times, sizes))]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    return rows.mapInArrow(look, f"{BASE}, n_best bigint, count_sum bigint").select(*RESULT)


def _fetched(rows: DataFrame, found: DataFrame, slices: int, most: np.ndarray) -> DataFrame:
    """Documents' pairs are sent to the slices, a hot slice in several copies, and the answers summed per document."""
    highest_of = rows.sparkSession.sparkContext.broadcast(most)  # one number for each entry of A's vocabulary
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # rows of one doc_id and digest have the same result: looked up once
    first = settle(rows.groupBy(*own).agg(F.first("keys").alias("keys"), F.first("times").alias("times"), F.count("*").alias("copies")), "documents")
    each = (first.select("doc_id", "groups_sha256", F.explode(F.arrays_zip("keys", "times")).alias("pair"))
            .select("doc_id", "groups_sha256", F.col("pair.keys").alias("key"), F.col("pair.times").alias("times"),
                    slice_of(F.col("pair.keys"), slices).alias("slice")))
    # a row for each slice: 65,536 at most, as there are fewer than 2 ** 32 pairs
    many = F.broadcast(each.groupBy("slice").agg(F.ceil(F.count("*") / BRANCH).alias("salts")))
    asked = each.join(many, "slice").withColumn("salt", F.pmod(F.xxhash64("doc_id", "groups_sha256"), F.col("salts"))).drop("salts")
    held = found.join(many, "slice").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")

    def look(keys: pa.Table, table: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "groups_sha256": pa.array([], pa.string()),
                             "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
        row = table.slice(0, 1).to_pylist()[0]
        counts = Counts([(row["slice"], row["hash"], row["keys"], row["counts"])], slices, highest_of.value)
        n, best = counts.of(keys.column("key").to_numpy())
        times = keys.column("times").to_numpy()
        answers = pa.table({"doc_id": keys.column("doc_id"), "groups_sha256": keys.column("groups_sha256"),
                            "n_best": pa.array(best * times), "count_sum": pa.array(n * times)})
        return (answers.group_by(["doc_id", "groups_sha256"]).aggregate([("n_best", "sum"), ("count_sum", "sum")])
                .rename_columns(["doc_id", "groups_sha256", "n_best", "count_sum"]))

    answers = (asked.groupBy("slice", "salt").cogroup(held.groupBy("slice", "salt"))
               .applyInArrow(look, "doc_id bigint, groups_sha256 string, n_best bigint, count_sum bigint")
               .groupBy(F.col("doc_id").alias("_id"), F.col("groups_sha256").alias("_digest"))
               .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("groups_sha256") == F.col("_digest"))
    return (first.join(answers, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
            .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")}).select(*RESULT))
