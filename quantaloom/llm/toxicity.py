"""Toxicity scores of whole texts by a recurrent network over all overlapping windows.

The network (see gru.py) is trained in one task, in numpy, from a bounded sample of labelled texts: the SAMPLE rows
with the smallest seeded hashes of their ids, or as many first ones of these as have SAMPLE_BYTES of text in all.
Labels are of whole texts, so training goes by turns: the present network picks the strongest windows of each toxic
text, and learns from those and from windows of the other texts. The first choice goes by the words and beginnings of
words that toxic texts hold more often. A part of the sample is held back to choose the turn that finds most toxic texts
where 0.9 and 0.99 of the others are left alone; a last fit maps the strongest logit of a text to a probability.

Scoring covers every window of every text, in tasks; the network (a few megabytes, whatever the input) is broadcast.

Defined results
  null or empty text, or no words: one empty window is scored. Several labels for an id: the largest counts. No labels
  at all: score 0. Only one class: its smoothed share. Repeated and null ids: a row each; an id that is repeated in
  the sample with several texts is learned from by the least of them. Empty table: no rows.
  Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import learned, small_batches
from .gru import GRAMS, PARTS, STATE, WINDOW, WORD_DIM, WORDS, Network, Spelling, sigmoid, windows_of, word_rows
from .shingles import text_chunks, words

#: Labelled texts, and bytes of them, that training uses at most; turns.
SAMPLE, SAMPLE_BYTES, TURNS = 3000, 64 << 20, 9
#: Share of words hidden in training; pull of parameters towards zero.
HIDDEN, PULL = 0.2, 1e-3
#: Windows that a turn learns from, at least.
LEAST_WINDOWS = 6000
THRESHOLD = 0.3


def labelled_rows(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE, seed: int = 13, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, y) of at most ``most`` labelled rows for whose id ``allowed`` holds."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").where(allowed).groupBy("id").agg(F.max("y").cast("long").alias("y"))
    picked = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    so_far = F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0))).over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id"))  # of SAMPLE rows at most
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select(F.col("id").cast("long").alias("id"), "text", "y")


def _texts_and_labels(sample: pa.Table) -> tuple[pa.Array, np.ndarray]:
    sample = sample.sort_by("id")
    return pa.array(sample.column("text").to_pylist(), pa.string()), sample.column("y").to_numpy().astype(np.float32)


def _of_sample(sample: pa.Table) -> Network:
    return train(*_texts_and_labels(sample))


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, **names) -> tuple[pa.Array, np.ndarray]:
    """(texts, labels) of ``labelled_rows``."""
    return learned(labelled_rows(docs, labels, allowed, **names), _texts_and_labels)


class _Sample:
    """Words and windows of the training texts. Words of one spelling are one kind."""

    def __init__(self, texts: pa.Array):
        h_all, first_all, n_words = [], [np.zeros(1, np.int64)], 0
        kinds, spelt = np.zeros(0, np.uint64), []
        for _, raw, offsets in text_chunks(texts):
            h, starts, ends, first = words(raw, offsets, PARTS)
            new, place = np.unique(h, return_index=True)
            fresh = ~np.isin(new, kinds)
            kinds = np.concatenate([kinds, new[fresh]])
            spelt += [raw[a:b] for a, b in zip(starts[place[fresh]].tolist(), ends[place[fresh]].tolist(), strict=True)]
            h_all.append(h)
            first_all.append(first[1:] + n_words)
            n_words += len(h)
        order = np.argsort(kinds)
        self.kinds = kinds[order]
        edges = np.concatenate([[0], np.cumsum([len(spelt[k]) for k in order.tolist()])]).astype(np.int64)
        self.spelling = Spelling(np.concatenate([np.zeros(0, np.uint8), *(spelt[k] for k in order.tolist())]), edges[:-1], edges[1:])
        self.rows = word_rows(self.kinds)
        self.kind, self.first = np.searchsorted(self.kinds, np.concatenate(h_all)).astype(np.int32), np.concatenate(first_all)
        self.row, self.at, self.end = windows_of(self.first)
        self.begin = np.searchsorted(self.row, np.arange(len(self.first)))  # windows of each text

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """Each (kind, text) that there is, once."""
        n = len(self.first)
        text = np.repeat(np.arange(n - 1), np.diff(self.first))
        both = np.unique(self.kind.astype(np.int64) * n + text)
        return both // n, both % n


def _evidence(rows: np.ndarray, text: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Signed root of the likelihood ratio of each table row's texts being toxic as often as all; 0 where as much would
    come up by chance among so many rows. (rows, text): what each text holds."""
    both = np.unique(rows.astype(np.int64) * len(y) + text)
    rows, text = both // len(y), both % len(y)
    with_, toxic, share = np.bincount(rows, minlength=n), np.bincount(rows, y[text], n), y.mean()
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0)
    ratio = np.sqrt(np.maximum(0, 2 * (part(toxic, with_ * share) + part(with_ - toxic, with_ * (1 - share)))))
    return np.where(ratio >= np.sqrt(2 * np.log(max(2, (with_ >= 3).sum()))), np.sign(toxic - with_ * share) * ratio, 0.0)


def word_evidence(sample: _Sample, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of each row of the word table, of the n-gram table as beginnings of words, of each kind)."""
    kind, text = sample.spread()
    start = sample.spelling.start
    by_word, by_gram = _evidence(sample.rows[kind], text, y, WORDS + 1), np.zeros(GRAMS + 1)
    found = [_evidence(start[kind, k], text, y, GRAMS + 1) for k in range(start.shape[1])]
    for one in found:
        one[GRAMS] = 0
        by_gram = np.where(np.abs(one) > np.abs(by_gram), one, by_gram)
    return by_word, by_gram, np.maximum(by_word[sample.rows], by_gram[start].max(1))


def _best(net: Network, sample: _Sample) -> tuple[np.ndarray, np.ndarray]:
    """The strongest logit of each text and all windows' logits."""
    n = len(sample.kinds)
    g = np.zeros((n + 1, 6 * STATE), np.float32)
    for k in range(0, n, 20_000):
        some = np.arange(k, min(k + 20_000, n))
        g[some] = net.gates(sample.rows[some], sample.spelling[some])[1]
    logits = net.logits(g, sample.at, sample.end, sample.kind)
    return np.maximum.reduceat(logits, sample.begin[:-1]), logits


def _learn(net: Network, sample: _Sample, windows: np.ndarray, y: np.ndarray, rng, moments: dict, rate: float, batch: int = 256) -> None:
    order = rng.permutation(len(windows))
    for k in range(0, len(order), batch):
        w, target = windows[order[k : k + batch]], y[order[k : k + batch]]
        at = sample.at[w, None] + np.arange(WINDOW)
        mask = (at < sample.end[w, None]).astype(np.float32)
        kinds, kind = np.unique(sample.kind[np.minimum(at, len(sample.kind) - 1)], return_inverse=True)
        kind = kind.reshape(at.shape)
        spelling = sample.spelling[kinds]
        word = np.where(rng.random(at.shape) < HIDDEN, 0, sample.rows[kinds][kind])  # some words are hidden, so spelling counts too
        x = np.concatenate([net.p["E"][word], spelling.vectors(net.p["G"])[kind]], axis=2)
        g = x @ net.p["W"] + net.p["b"]
        keep: dict = {}
        d = (sigmoid(net.forward(g * mask[:, :, None], mask, keep)) - target).astype(np.float32) / len(w)
        grad, d_g = net.backward(d, mask, keep)
        d_g *= mask[:, :, None]
        flat, d_flat = x.reshape(-1, x.shape[2]), d_g.reshape(-1, 6 * STATE)
        grad["W"], grad["b"] = flat.T @ d_flat, d_flat.sum(0)
        d_x = d_flat @ net.p["W"].T
        by = lambda rows, v, n: np.stack([np.bincount(rows, v[:, j], n) for j in range(v.shape[1])], axis=1).astype(np.float32)
        grad["G"] = spelling.gradient(by(kind.ravel(), d_x[:, WORD_DIM:], len(kinds)))
        grad["E"] = by(word.ravel(), d_x[:, :WORD_DIM], len(net.p["E"]))
        grad["E"][0] = 0
        moments["t"] += 1
        for name, v in grad.items():
            v = v + PULL * net.p[name]
            m, s = moments.setdefault(name, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
            moments[name] = m, s
            net.p[name] -= (rate * m / (1 - 0.9 ** moments["t"]) / (np.sqrt(s / (1 - 0.99 ** moments["t"])) + 1e-7)).astype(np.float32)


def caught(strength: np.ndarray, y: np.ndarray, alone: float) -> float:
    """Share of the toxic texts that are stronger than this share of the others."""
    return float((strength[y == 1] > np.quantile(strength[y == 0], alone)).mean())


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic fit with a light pull towards (1, 0)."""
    s, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(s * logit + b)
        e, w = p - y, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(e * logit).sum() + 0.1 * (s - 1), e.sum() + 0.01 * b])
        hess = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        s, b = s - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(s, 0.05), b


def train(texts: pa.Array, y: np.ndarray, turns: int = TURNS, seed: int = 3) -> Network:
    """A network for these texts and their labels (0 or 1)."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
        net.scale, net.shift = 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    sample = _Sample(texts)
    if not len(sample.kind):  # no words at all
        return train(texts, np.full(1, y.mean()), turns)
    tested = rng.random(len(y)) < 0.2 if len(y) >= 200 else np.zeros(len(y), bool)
    if not (tested & (y == 1)).any() or not (tested & (y == 0)).any() or not (~tested & (y == 1)).any() or not (~tested & (y == 0)).any():
        tested[:] = False
    seen = tested if tested.any() else ~tested
    positive, negative = np.flatnonzero(~tested & (y == 1)), np.flatnonzero(~tested & (y == 0))
    net.p["c"][0] = -1.0
    moments: dict = {"t": 0}
    repeat = max(1, LEAST_WINDOWS // (3 * len(positive) + 2 * len(negative)))  # few texts are gone over more often
    best, saved = (-1.0, -np.inf), None
    # The first embeddings carry the evidence of counts, and the first choice of windows goes by it.
    by_word, by_gram, evidence = word_evidence(sample, np.where(tested, y.mean(), y))
    net.p["E"][:, 0] += np.clip(by_word / 3, -2, 2).astype(np.float32)
    net.p["G"][:, 0] += np.clip(by_gram / 3, -2, 2).astype(np.float32)
    summed = np.concatenate([[0.0], np.cumsum(np.maximum(0, evidence)[sample.kind])])
    logits = (summed[np.minimum(sample.at + WINDOW, sample.end)] - summed[sample.at]).astype(np.float32)
    for turn in range(turns):
        some = lambda texts, k: np.concatenate([rng.integers(sample.begin[i], sample.begin[i + 1], k) for i in texts])
        top = lambda texts: np.array([sample.begin[i] + np.argmax(logits[sample.begin[i] : sample.begin[i + 1]]) for i in texts])
        good = np.repeat(top(positive), 3 * repeat)
        bad = np.concatenate([some(negative, repeat), np.repeat(top(negative), repeat)])
        windows, target = np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))]).astype(np.float32)
        _learn(net, sample, windows, target, rng, moments, 0.02 if turn < turns // 2 else 0.007)
        strongest, logits = _best(net, sample)
        strength, truth = strongest[seen].astype(np.float64), y[seen]
        scale, shift = _calibrate(strength, truth)
        p = np.clip(sigmoid(scale * strength + shift), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p)))
        mark = caught(strength, truth, 0.9) + caught(strength, truth, 0.99), -loss
        if turn >= min(3, turns - 1) and mark > best:
            best, saved = mark, ({k: v.copy() for k, v in net.p.items()}, scale, shift)
    net.p, net.scale, net.shift = saved
    return net


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, **names) -> Network:
    """The network is trained in a task."""
    small_batches(docs.sparkSession)
    return learned(labelled_rows(docs, labels, F.lit(True) if allowed is None else allowed, **names), _of_sample)


def score(docs: DataFrame, net: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *sent.value.scores(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, score double").withColumnRenamed("id", id)


def reject(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score at the threshold or above; all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    sent, place = spark.sparkContext.broadcast(net), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *sent.value.scores(batch.column(place))])
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
