"""Operator 3, language ID: a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes forwards and backwards, labels every position with
language probabilities, and a document's probabilities are the means over its positions.  It is
trained by backpropagation through time on windows of labelled documents.

Fitting uses a bounded sample: ``sample`` documents of each language, taken by hash, one window
of ``width`` bytes each, and the ``most`` languages with the most documents.  Prediction reads every
whole text: texts are cut into segments of ``width`` bytes without gaps, and each task runs all
segments of a batch side by side.

Such a network always names one of its languages.  Whether a text is like them at all is told by
its strangeness: the mean surprise of its byte pairs under a language's pair frequencies, as a share
of what nearly all of that language's own windows stay below (those kept from the frequencies), with
room beside it and more for short texts; the least of the ``NEAR`` likeliest languages.  Above 1 it is
like none of them.  Upper case does not count, nor do pairs other than of letters, or a letter and a space.

Repeated rows are labelled alike, and teach once.  An empty table teaches nothing and has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treecensus.llm.common import pieces_of, slim

SAMPLE, MOST = 1000, 200
HIDDEN = 8
WIDTH = 128
ROUNDS = 250
UNKNOWN = "und"
NEAR = 3
SIDE = 2048


def sigmoid_of(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes (lower-cased) that belong to a letter, for all that bytes alone tell."""
    return ((data >= 97) & (data <= 122)) | (data >= 128)


def in_words(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of two letters, or of a letter and a space or line end."""
    a, b = letters(first), letters(second)
    return (a & b) | (a & ((second == 32) | (second == 10))) | (b & ((first == 32) | (first == 10)))


class Pairs:
    """How surprising a language's byte pairs are, and how surprising a text of it may be."""

    USUAL, BESIDE = 0.98, 1.3  # a share of windows, and the room beside the strangest of these
    ROOM = 4.0  # standard errors of a text's own mean

    def __init__(self, windows: np.ndarray, labels: np.ndarray, languages: int):
        self.surprise = np.zeros((languages, 1 << 16), np.float32)
        self.limit, self.spread = np.zeros(languages), np.zeros(languages)
        for k in range(languages):
            own = lowered(windows[labels == k].astype(np.int64))
            aside = np.arange(len(own)) % 4 == 3 if len(own) >= 8 else np.ones(len(own), bool)
            learnt = own[~aside] if len(own) >= 8 else own
            single = np.bincount(learnt.ravel(), minlength=256) + 0.05
            counts = np.bincount((learnt[:, :-1] * 256 + learnt[:, 1:]).ravel(), minlength=1 << 16).reshape(256, 256)
            share = (counts + single / single.sum()) / (counts.sum(axis=1, keepdims=True) + 1)
            self.surprise[k] = -np.log(share).ravel()
            rest = own[aside]
            each = self.surprise[k][rest[:, :-1] * 256 + rest[:, 1:]]
            counted = in_words(rest[:, :-1], rest[:, 1:])
            n = counted.sum(axis=1)
            means = (each * counted).sum(axis=1)[n > 0] / n[n > 0]
            self.limit[k] = self.BESIDE * np.quantile(means, self.USUAL) if len(means) else 0.0
            self.spread[k] = each[counted].std() if counted.any() else 0.0

    def strangeness(self, data: np.ndarray, offsets: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Mean surprise of each text as a share of its language's limit, the least over the named ones (texts, languages).

        Text i is data[offsets[i]:offsets[i + 1]].
        """
        sizes, data = np.diff(offsets), lowered(data.astype(np.int64))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if len(data) < 2:
            return np.zeros(len(sizes))
        first, second = data[:-1], data[1:]
        use = (owner[:-1] == owner[1:]) & in_words(first, second)
        whose, pairs = owner[:-1][use], (first * 256 + second)[use]
        n = np.bincount(whose, minlength=len(sizes))
        least = np.full(len(sizes), np.inf)
        for own in named.T:
            total = np.bincount(whose, self.surprise[own[whose], pairs], len(sizes))
            allowed = self.limit[own] + self.ROOM * self.spread[own] / np.sqrt(np.maximum(n, 1))
            least = np.minimum(least, total / np.maximum(n, 1) / np.maximum(allowed, 1e-9))
        return np.where(n > 0, least, 0.0)


class Network:
    """Two gated recurrent layers (one for each direction) and a softmax over both at every position.

    Inputs are one-hot bytes, so a layer's input weights are a table with a row for each byte.
    Columns of the weights: update gate, reset gate, candidate.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        draw, h = np.random.default_rng(seed), hidden
        small = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        self.languages, self.hidden, self.pairs = languages, hidden, None
        self.weights = {}
        for way in "fb":
            self.weights |= {f"{way}in": small(256, 3 * h), f"{way}gates": small(h, 2 * h), f"{way}cand": small(h, h),
                             f"{way}out": small(h, len(languages))}
        self.weights["bias"] = np.zeros(len(languages), np.float32)

    def layer(self, way: str, bytes_: np.ndarray, keep: bool = False):
        """Hidden states (time, side, hidden) of bytes (time, side); with all inner values if they are kept."""
        w_in, gates, cand = (self.weights[way + k] for k in ("in", "gates", "cand"))
        h = self.hidden
        time, side = bytes_.shape
        states = np.empty((time, side, h), np.float32)
        state, kept = np.zeros((side, h), np.float32), []
        for t in range(time):
            x = w_in[bytes_[t]]
            both = state @ gates
            both += x[:, :2 * h]
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            z, r = both[:, :h], both[:, h:]
            inner = r * state
            new = inner @ cand
            new += x[:, 2 * h:]
            np.tanh(new, out=new)
            if keep:
                kept.append((state, z, r, inner, new))
            state = new + z * (state - new)
            states[t] = state
        return states, kept

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Language probabilities at each position, from states that are aligned by position."""
        w = self.weights
        scores = forward @ w["fout"]
        scores += backward @ w["bout"]
        scores += w["bias"]
        scores -= scores.max(axis=-1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        return scores

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients, by backpropagation through time."""
        time, side = bytes_.shape
        forward, kept_f = self.layer("f", bytes_, True)
        reverse, kept_b = self.layer("b", bytes_[::-1], True)
        p = self.probabilities(forward, reverse[::-1])
        loss = -np.log(p[:, np.arange(side), labels] + 1e-9).mean()
        p[:, np.arange(side), labels] -= 1
        p /= time * side
        slopes = {"bias": p.sum(axis=(0, 1))}
        for way, states, kept, order, errors in (
                ("f", forward, kept_f, bytes_, p), ("b", reverse, kept_b, bytes_[::-1], p[::-1])):
            slopes |= self._back(way, states, kept, order, errors)
        return float(loss), slopes

    def _back(self, way, states, kept, bytes_, errors):
        h, w = self.hidden, self.weights
        gates, cand, out = w[way + "gates"], w[way + "cand"], w[way + "out"]
        d_in, d_gates, d_cand = np.zeros_like(w[way + "in"]), np.zeros_like(gates), np.zeros_like(cand)
        d_out = np.einsum("tsh,tsl->hl", states, errors)
        carry = np.zeros_like(states[0])
        for t in range(len(states) - 1, -1, -1):
            before, z, r, inner, new = kept[t]
            d_state = errors[t] @ out.T + carry
            d_new = d_state * (1 - z) * (1 - new * new)
            d_inner = d_new @ cand.T
            d_z = d_state * (before - new) * z * (1 - z)
            d_r = d_inner * before * r * (1 - r)
            d_both = np.concatenate([d_z, d_r], axis=1)
            d_gates += before.T @ d_both
            d_cand += inner.T @ d_new
            np.add.at(d_in, bytes_[t], np.concatenate([d_both, d_new], axis=1))
            carry = d_state * z + d_inner * r + d_both @ gates.T
        return {way + "in": d_in, way + "gates": d_gates, way + "cand": d_cand, way + "out": d_out}

    def train(self, windows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, side: int = 96, rate: float = 0.02):
        """Adam over random batches of windows (count, width)."""
        draw = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for n in range(1, rounds + 1):
            own = draw.integers(0, len(windows), side)
            _, slopes = self.gradients(windows[own].T, labels[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
            step = rate * min(1.0, 2 * (1 - n / (rounds + 1)))
            for k, g in slopes.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= step * (first[k] / (1 - 0.9 ** n)) / (np.sqrt(second[k] / (1 - 0.99 ** n)) + 1e-8)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, side: int = SIDE) -> np.ndarray:
        """Mean probabilities of each text; text i is data[offsets[i]:offsets[i + 1]] (UTF-8 bytes)."""
        sizes = np.diff(offsets)
        per = -(-sizes // width)
        owner = np.repeat(np.arange(len(sizes)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[:-1][owner] + within * width
        length = np.minimum(width, offsets[1:][owner] - begin)
        sums = np.zeros((len(sizes), len(self.languages)))
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), side):
            own = order[a:a + side]
            n, time = length[own], int(length[own[0]])
            steps = np.arange(time)[:, None]
            valid = steps < n
            ahead = data[np.where(valid, begin[own] + steps, begin[own])]
            mirror = np.where(valid, n - 1 - steps, 0)
            forward, _ = self.layer("f", ahead)
            reverse, _ = self.layer("b", np.take_along_axis(ahead, mirror, axis=0))
            aligned = reverse[::-1] if n[-1] == time else reverse[mirror, np.arange(len(own))]
            p = self.probabilities(forward, aligned)
            if n[-1] != time:
                p *= valid[:, :, None]
            np.add.at(sums, owner[own], p.sum(axis=0))
        return sums / np.maximum(sizes, 1)[:, None]


def sample_windows(documents: DataFrame, learn: Column, sample: int, width: int, most: int = MOST,
                   ) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, byte windows and labels of a bounded sample of the labelled texts.

    Of the ``most`` languages with the most texts the ``sample`` texts with the smallest hashes; of each
    text the window at a place drawn by its hash.  Texts are counted by language first, so that only
    those below a share of the range of hashes, about half more than wanted, are brought together to be ranked.
    """
    text = F.encode("text", "UTF-8")
    room = F.greatest(F.length(text) - width, F.lit(0)) + 1
    usable = documents.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", F.xxhash64("text", "doc_id").alias("h"), "text")
    counts = (usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(most).collect())  # a row a language, ``most`` at most
    if not counts:
        return [], np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    shares = documents.sparkSession.createDataFrame(
        [(r.lang, min(1.5 * sample / max(r.n, 1), 2.0)) for r in counts], "lang string, share double")
    low = usable.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share"))
    cut = low.select("lang", "h", F.substring(
        text, F.pmod(F.xxhash64("text"), room).cast("int") + 1, F.lit(width)).alias("w")).distinct()
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "w"))).where(F.col("k") <= sample)
    rows = ranked.orderBy("lang", "h", "w").select("lang", "w").toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    windows = np.zeros((rows.num_rows, width), np.uint8)
    for i, w in enumerate(rows["w"].to_pylist()):
        own = np.frombuffer(w, np.uint8)
        windows[i] = np.resize(own, width)  # short texts are repeated
    return languages, windows, np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)


def fit(documents: DataFrame, learn: Column, sample: int = SAMPLE, width: int = WIDTH, rounds: int = ROUNDS) -> Network | None:
    """A network for the languages of the rows where ``learn`` holds; None if none is labelled."""
    languages, windows, labels = sample_windows(documents, learn, sample, width)
    if not languages:
        return None
    shares = np.bincount(labels)
    even = np.concatenate([np.resize(np.flatnonzero(labels == k), shares.max()) for k in range(len(languages))])
    network = Network(languages).train(windows[even], labels[even], rounds)
    network.pairs = Pairs(windows, labels, len(languages))
    return network


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``strangeness`` to documents with a column ``text``; all other columns stay.

    A null text, one without a letter, or a missing network gives ``und`` with score and strangeness 0.
    Columns of these three names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(network)
    columns = [c for c in documents.columns if c not in ("lang_pred", "score", "strangeness")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces_of(batches):
            texts = batch.column("text").to_pylist()
            known = [model is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            raw = [t.encode() if k else b"" for t, k in zip(texts, known)]
            names, scores, strange = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if any(known):
                data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
                p = model.pooled(data, offsets)
                best = p.argmax(axis=1)
                if model.pairs is not None:
                    strange = model.pairs.strangeness(data, offsets, np.argsort(-p, axis=1, kind="stable")[:, :NEAR])
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(columns).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(strange, pa.float64())],
                [*columns, "lang_pred", "score", "strangeness"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return documents.select(*columns).mapInArrow(slim(label), f"{schema}, lang_pred string, score double, strangeness double")


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a document is kept from learning: its crc32 has no remainder. A null id counts as 0 (held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0)) == 0
