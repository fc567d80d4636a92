"""Operator 4, quality by co-training: two views of a page teach each other.

The text view sees what a document says (hashed words, word shapes, repetition); the metadata
view sees what is known about the page (source, language, length, layout of its lines).  Each starts
from the labelled rows.  In every round a classifier of each view scores all other rows; those it
is surest of become pseudo-labels for the other view, a share of all rows that grows by ``share`` a
round.  Then both are calibrated on labelled rows that neither has learnt from (a logistic scale for
each), and combined by whichever explains those rows best across folds: a logistic regression on
both log-odds, or one view alone.

A classifier is the log ratio of its features' smoothed shares in both classes, so all it needs of
the rows are sums, and Spark makes these: views are computed once and written, a round reads them
twice (counts of rounded log-odds, from which the thresholds follow, and sums of features beyond the
thresholds).  No pseudo-labelled row reaches the driver, and sums are of integers, so their order
does not matter.  The sums of pseudo-labelled rows weigh at most as much as those of labelled ones,
whatever the size of the table.

Only the labelled sample is bounded: ``labelled`` ids, taken by hash, and of the rows of a repeated id
the one with the smallest hash.  All rows outside it are unlabelled, without or with a doc_id, and
those with equal views count once, so copies teach no more than one row.  Every document is scored,
on its whole text; nulls in any column are facts of their own, and a null text is an empty one.
Without labels of both kinds there is no model: scores are null and everything is kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treecensus.llm.common import pieces_of, settle

LABELLED = 4000
TEXT, META = 2048, 512
LONG, GRAM = 32, 3
ROUNDS, SHARE = 4, 0.05
UNIT = 4096  # a feature of weight 1
STEP, REACH = 64, 64  # log-odds are counted in steps of 1/64 up to 64
SMOOTH = 0.1
SHAPE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)


def place(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def counted(text: str) -> Counter[str]:
    """The words of a text with their counts; of a run over ``LONG`` characters all its overlapping ``GRAM``-grams.

    Scripts without spaces, minified code and encoded lines are such runs, and every character of them counts.
    """
    seen = Counter(text.split())
    for run in [w for w in seen if len(w) > LONG]:
        n = seen.pop(run)
        for gram, m in Counter(map("".join, zip(*(run[k:] for k in range(GRAM))))).items():
            seen[gram] += n * m
    return seen


def text_view(text: str | None) -> dict[int, float]:
    """Hashed counts of words and of word shapes, as square roots of their shares; repetition in tenths."""
    seen, found = counted(text or ""), Counter()
    if not seen:
        return {place("empty", TEXT): 1.0}
    total = seen.total()
    for word, n in seen.items():
        found[place(word.lower(), TEXT)] += n
        shape = word[-4:].translate(SHAPE)
        found[place("shape " + shape, TEXT)] += n
    view = {k: (n / total) ** 0.5 for k, n in found.items()}
    for name in (f"distinct {int(10 * len(seen) / total)}", f"most {int(10 * max(seen.values()) / total)}"):
        view[place(name, TEXT)] = view.get(place(name, TEXT), 0.0) + 1.0
    return view


def meta_view(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> dict[int, float]:
    """What is known about a page: where it is from, its language, how long it is and how it is laid out."""
    text = text or ""
    rows, size = text.split("\n"), max(n_chars or 0, 0)
    lines, filled = len(rows), [r.rstrip() for r in rows if r.strip()]
    ended = sum(r[-1] in ".!?\u3002" for r in filled)
    facts = (f"source {source}", f"lang {lang}", f"size {int(4 * np.log2(size + 1))}", f"lines {int(2 * np.log2(lines))}",
             f"line {int(2 * np.log2(size / lines + 1))}", f"lang {lang} size {int(np.log2(size + 1))}",
             f"ended {round(5 * ended / max(len(filled), 1))}", f"blank {round(5 * (lines - len(filled)) / lines)}",
             f"spaces {round(25 * sum(map(text.count, ' \t')) / max(len(text), 1))}")
    return {place(fact, META): 1.0 for fact in facts}


def dense(views: list[dict[int, float]], size: int) -> np.ndarray:
    out = np.zeros((len(views), size), np.float32)
    for i, view in enumerate(views):
        out[i, list(view)] = list(view.values())
    return out


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 1.0, decay: float = 1e-3, even: bool = True) -> Linear:
    """Logistic regression by accelerated gradients; both classes weigh the same if ``even``.

    All in single precision: a product with a double vector would copy the whole matrix in every step.
    """
    x, w, b = np.ascontiguousarray(x, np.float32), np.zeros(x.shape[1], np.float32), 0.0
    weigh = np.where(y, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) if even else np.ones(len(y))
    step = rate / max(0.25 * float((x * x).sum(axis=1).mean() + 1), 1e-6)
    speed_w, speed_b = np.zeros_like(w), 0.0
    for _ in range(steps):
        ahead_w, ahead_b = w + np.float32(0.9) * speed_w, b + 0.9 * speed_b
        error = (weigh * (1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -30, 30))) - y) / len(y)).astype(np.float32)
        speed_w = np.float32(0.9) * speed_w - np.float32(step) * (error @ x + np.float32(decay) * ahead_w)
        speed_b = 0.9 * speed_b - step * float(error.sum())
        w, b = w + speed_w, b + speed_b
    return Linear(w, float(b))


@dataclass
class Model:
    text: Linear
    meta: Linear
    scales: list[Linear]
    mix: Linear

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, of the metadata view, and of both together, from both log-odds."""
        odds = np.stack([s.odds(v[:, None]) for s, v in zip(self.scales, (text, meta))], axis=1)
        return likely(odds[:, 0]), likely(odds[:, 1]), likely(self.mix.odds(odds))


def likely(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Sums:
    """Rows of both classes (bad, good) and, of each view, the sums of their features."""
    rows: np.ndarray
    text: np.ndarray
    meta: np.ndarray

    @classmethod
    def none(cls) -> Sums:
        return cls(np.zeros(2), np.zeros((2, TEXT)), np.zeros((2, META)))


def ratio(own: np.ndarray, told: np.ndarray, own_rows: np.ndarray, told_rows: np.ndarray) -> Linear:
    """The log ratio of features' shares in good and bad rows; told rows of a class weigh at most as much as its own."""
    weigh = np.minimum(1, own_rows / np.maximum(told_rows, 1))[:, None]
    both = (own + told * weigh) / UNIT + SMOOTH
    shares = np.log(both / both.sum(axis=1, keepdims=True))
    return Linear(shares[1] - shares[0], 0.0)


def thresholds(counts: dict[int, int], share: float, good: float) -> tuple[int, int]:
    """Steps up to which a row is surely bad, and from which it is surely good, for ``share`` of all rows."""
    total, low, high = sum(counts.values()), -REACH * STEP - 1, REACH * STEP + 1
    for wanted, steps, side in ((share * (1 - good), sorted(k for k in counts if k < 0), 0),
                                (share * good, sorted((k for k in counts if k > 0), reverse=True), 1)):
        taken = 0
        for k in steps:
            if taken >= wanted * total:
                break
            taken += counts[k]  # rows of one step go together
            low, high = (k, high) if side == 0 else (low, k)
    return low, high


def best_mix(odds: np.ndarray, y: np.ndarray, folds: int = 5) -> Linear:
    """Both views by logistic regression, or one alone: whichever has the least log-loss on rows it was not fitted on."""
    part = np.arange(len(y)) % folds
    loss = lambda m, x, t: float(-np.log(np.where(t, likely(m.odds(x)), 1 - likely(m.odds(x)))).sum())
    fitted = lambda x, t: logistic(x, t, decay=1e-4, even=False, steps=400)
    alone = [Linear(np.array(w), 0.0) for w in ((1.0, 0.0), (0.0, 1.0))]
    tried = [(loss(m, odds, y), m) for m in alone]
    together = sum(loss(fitted(odds[part != k], y[part != k]), odds[part == k], y[part == k]) for k in set(part.tolist()))
    return min([*tried, (together, fitted(odds, y))], key=lambda found: found[0])[1]


def weighed(at: pa.Array, weights: np.ndarray, value: pa.Array | None = None) -> np.ndarray:
    """For each row of a list column, the sum of its features' weights (times their values)."""
    each = weights[at.flatten().to_numpy()]
    if value is not None:
        each = each * (value.flatten().to_numpy() / UNIT)
    return np.bincount(np.repeat(np.arange(len(at)), at.value_lengths().to_numpy()), each, len(at))


def odds_of(batch: pa.RecordBatch, text: Linear, meta: Linear) -> tuple[np.ndarray, np.ndarray]:
    return (weighed(batch.column("text_at"), text.weights, batch.column("text_value")),
            weighed(batch.column("meta_at"), meta.weights))


def stepped(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds * STEP), -REACH * STEP, REACH * STEP).astype(np.int64)


def summed(rows: pa.RecordBatch | pa.Table, good: np.ndarray, view: str, chosen: np.ndarray | None = None) -> np.ndarray:
    """Sums of a view's features over rows of both classes (of the chosen rows)."""
    size = TEXT if view == "text" else META
    at = rows.column(f"{view}_at")
    at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
    lengths, flat = at.value_lengths().to_numpy(), at.flatten().to_numpy().astype(np.int64)
    value = np.full(len(flat), UNIT)
    if view == "text":
        held = rows.column("text_value")
        value = (held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held).flatten().to_numpy()
    use = np.repeat(np.ones(len(at), bool) if chosen is None else chosen, lengths)
    places = flat[use] + size * np.repeat(good, lengths)[use]
    return np.bincount(places, value[use], 2 * size).reshape(2, size)


def steps_of(pool: DataFrame, text: Linear, meta: Linear) -> list[dict[int, int]]:
    """Of each view, how many rows of the pool have which rounded log-odds."""
    shared = pool.sparkSession.sparkContext.broadcast((text, meta))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for own, odds in zip(found, odds_of(batch, *shared.value)):
                own.update(dict(zip(*(a.tolist() for a in np.unique(stepped(odds), return_counts=True)))))
        rows = [(view, step, n) for view, own in enumerate(found) for step, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (
            pa.int32(), pa.int32(), pa.int64()))], ["view", "step", "n"])

    counts = pool.mapInArrow(count, "view int, step int, n bigint").groupBy("view", "step").agg(F.sum("n").alias("n"))
    out: list[dict[int, int]] = [{}, {}]
    for view, step, n in counts.collect():  # two views of 2 * REACH * STEP + 1 steps at most
        out[view][step] = n
    return out


def told_by(pool: DataFrame, text: Linear, meta: Linear, limits: list[tuple[int, int]]) -> tuple[Sums, Sums]:
    """What each view tells the other: sums of the other view's features over the rows beyond its thresholds.

    The first result is for the text view (told by the metadata view), the second for the metadata view.
    """
    shared = pool.sparkSession.sparkContext.broadcast((text, meta, limits))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *models, bounds = shared.value
        totals = {"text": np.zeros(2 * TEXT + 2), "meta": np.zeros(2 * META + 2)}
        for batch in batches:
            odds = odds_of(batch, *models)
            for view, by in (("text", 1), ("meta", 0)):
                step, (low, high) = stepped(odds[by]), bounds[by]
                good = (step >= high).astype(np.int64)
                sure = (step <= low) | (step >= high)
                totals[view] += np.concatenate([summed(batch, good, view, sure).ravel(), np.bincount(good[sure], minlength=2)])
        for view, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([view] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(total[at].astype(np.int64))], ["view", "place", "n"])

    sums = pool.mapInArrow(collect, "view string, place int, n bigint").groupBy("view", "place").agg(F.sum("n").alias("n"))
    flat = {"text": np.zeros(2 * TEXT + 2), "meta": np.zeros(2 * META + 2)}
    for view, at, n in sums.collect():  # 2 * (TEXT + META) + 4 rows at most
        flat[view][at] = n
    out = Sums.none(), Sums.none()
    for told, view, size in ((out[0], "text", TEXT), (out[1], "meta", META)):
        told.rows[:] = flat[view][2 * size:]
        getattr(told, view)[:] = flat[view][:2 * size].reshape(2, size)
    return out


def co_train(known: pa.Table, y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Both views over some rounds of exchanged pseudo-labels; every fourth labelled row is for calibration."""
    aside = np.arange(len(y)) % 4 == 3
    learnt, good = known.filter(pa.array(~aside)), y[~aside].astype(np.int64)
    own = Sums(np.bincount(good, minlength=2).astype(float), summed(learnt, good, "text"), summed(learnt, good, "meta"))
    told = Sums.none(), Sums.none()
    for turn in range(rounds + 1):
        text = ratio(own.text, told[0].text, own.rows, told[0].rows)
        meta = ratio(own.meta, told[1].meta, own.rows, told[1].rows)
        if turn == rounds:
            break
        limits = [thresholds(c, (turn + 1) * share, float(good.mean())) for c in steps_of(pool, text, meta)]
        told = told_by(pool, text, meta, limits)
    odds = odds_of(known.filter(pa.array(aside)).combine_chunks().to_batches()[0], text, meta)
    scales = [logistic(o[:, None], y[aside], decay=1e-4, even=False, steps=400) for o in odds]
    both = np.stack([s.odds(o[:, None]) for s, o in zip(scales, odds)], axis=1)
    return Model(text, meta, scales, best_mix(both, y[aside]))


def views(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of both views, and the views, for every row of documents."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(
        _views, f"doc_id {kind}, h bigint, text_at array<smallint>, text_value array<smallint>, meta_at array<smallint>")


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    small = pa.list_(pa.int16())
    for batch in pieces_of(batches):
        rows = batch.to_pylist()
        text = [text_view(r["text"]) for r in rows]
        meta = [sorted(meta_view(r["source"], r["lang"], r["n_chars"], r["text"])) for r in rows]
        at = [sorted(v) for v in text]
        value = [[round(UNIT * v[k]) for k in places] for v, places in zip(text, at)]
        h = [int.from_bytes(hashlib.blake2b(repr(v).encode(), digest_size=8).digest(), "little", signed=True)
             for v in zip(at, value, meta)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(h, pa.int64()), pa.array(at, small), pa.array(value, small), pa.array(meta, small)],
            ["doc_id", "h", "text_at", "text_value", "meta_at"])


def split(seen: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, DataFrame]:
    """Written views in two: the labelled sample, one row an id, and all rows outside it, equal ones once."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = seen.where("doc_id IS NOT NULL").select("doc_id").distinct().join(known, "doc_id")
    chosen = settle(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labelled-sample")
    of = ("h", "text_at", "text_value", "meta_at")
    sample = (seen.join(F.broadcast(chosen), "doc_id")  # ``labelled`` rows at most
              .groupBy("doc_id", "quality").agg(F.min(F.struct(*of)).alias("r"))
              .select("doc_id", "quality", *(f"r.{c}" for c in of)))
    rest = seen.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    return sample, rest.select(*of).dropDuplicates(["h"]).drop("h")


def learn(seen: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """A model from written views and labels; None if there are not labels of both kinds."""
    sample, rest = split(seen, labels, labelled)
    known = sample.orderBy(F.xxhash64(F.xxhash64("doc_id")), "doc_id").toArrow()
    y = np.array([q == 1 for q in known["quality"].to_pylist()], bool)
    if len(y) < 8 or y[np.arange(len(y)) % 4 != 3].all() or not y[np.arange(len(y)) % 4 != 3].any() or y[3::4].all() or not y[3::4].any():
        return None
    return co_train(known, y, settle(rest, "pool"), rounds)


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    return learn(settle(views(documents), "views"), labels, labelled)


def score_views(seen: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept for every row of the views."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if known is None:
                found = [pa.nulls(batch.num_rows, pa.float64())] * 3
                kept = [True] * batch.num_rows
            else:
                scores = known.score(*odds_of(batch, known.text, known.meta))
                found, kept = [pa.array(p) for p in scores], scores[2] >= least
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found, pa.array(kept, pa.bool_())],
                                             ["doc_id", "p_text", "p_meta", "score", "kept"])

    kind = seen.schema["doc_id"].dataType.simpleString()
    return seen.drop("h").mapInArrow(judge, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")


def score(documents: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept for every row of documents."""
    return score_views(views(documents), model, least)


def judge(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Scores of all documents by a model learnt from them and their labels; texts are read once."""
    seen = settle(views(documents), "views")
    return score_views(seen, learn(seen, labels, labelled))
