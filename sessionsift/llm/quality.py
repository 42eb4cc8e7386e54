"""Document quality by Bradley-Terry pairwise ranking.

Every labelled good document is preferred to every labelled bad one: P(a before b) = sigmoid(w.(f(a) - f(b))).
``fit`` learns w by Newton steps on the logistic loss of feature differences of random (good, bad) pairs.
The threshold is a quantile of the training scores: as many fall below it as the labels mark bad.  The score
shown is sigmoid(w.f + shift), where the shift puts that threshold at ``cut``.

The labelled rows are a bounded sample (``sample_rows`` labels in the order of a hash of their id); features
are computed from whole texts in the tasks, and scoring is one pass over the documents without a shuffle.
Inputs of a score are the text's bytes only.

Defined cases: a null text is an empty one; texts without words have their own score like any other text
(all features zero); labels that are null or neither 0 nor 1 are ignored; several labels of one document
count as the largest; if either class has no labelled document there is nothing to prefer, and every
document gets the score ``cut`` (and is kept); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift.llm.bytekit import SPACE, Words, char_count, slices
from sessionsift.llm.common import crc_of_id, staged

CUT = 0.7
SAMPLE_ROWS = 20_000
PAIRS = 100_000

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(_PUNCTUATION) + 12


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES numbers for each text of a slice."""
    n = len(off) - 1
    doc_of_byte = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(doc_of_byte * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    chars = np.maximum(char_count(data, off), 1)
    words = Words(data, off, ~SPACE)
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    h, doc = words.hash, words.doc
    order = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    if len(h):
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)
    distinct = np.bincount(doc[order][new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][new], runs)
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    upper, lower = hist[:, 65:91].sum(axis=1), hist[:, 97:123].sum(axis=1)
    one_byte = np.bincount(doc, weights=words.end - words.start <= 1, minlength=n) if len(doc) else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, words.end - words.start)
    last = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    closes = np.bincount(doc, weights=np.isin(last, [33, 44, 46, 58, 59, 63]), minlength=n) if len(doc) else np.zeros(n)
    own = np.stack([
        upper / np.maximum(upper + lower, 1), hist[:, 48:58].sum(axis=1) / chars, hist[:, 128:].sum(axis=1) / chars,
        10 * hist[:, 10] / some, (hist[:, 32] + hist[:, 9]) / chars, np.bincount(doc, weights=words.end - words.start, minlength=n) / some / 10,
        np.log1p(longest) / 5, distinct / some, again / some, top / some, one_byte / some, closes / some], axis=1)
    rates = np.log1p(20 * hist[:, _PUNCTUATION] / some[:, None])
    out = np.concatenate([rates, own], axis=1)
    out[n_words == 0] = 0
    return out


def features_of(texts: pa.Array) -> np.ndarray:
    batch = pa.record_batch([texts], names=["text"])
    parts = [features(data, off) for _, data, off in slices(batch)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    shift: float

    def column(self, text: Column | str) -> Column:
        """The score of a text, 0 to 1."""
        weights, shift = self.weights, self.shift

        @F.arrow_udf("double")
        def quality(texts: pa.Array) -> pa.Array:
            raw = np.clip(features_of(texts) @ weights + shift, -500, 500)
            return pa.array(1 / (1 + np.exp(-raw)))

        return quality(text)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 42) -> np.ndarray:
    """Weights that minimise the logistic loss of sampled preference pairs (good over bad)."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([good, bad])
    scale = every.std(axis=0)
    scale[scale < 1e-9] = np.inf  # constant features say nothing
    diff = (good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]) / scale
    w = np.zeros(diff.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -500, 500)))
        gradient = diff.T @ (1 - p) / pairs - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text)."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most sample_rows narrow rows: safe to broadcast
    sample = staged(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-labels")

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        x = features_of(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    table = rows.select("doc_id", "quality", vector("text").alias("x")).toArrow()
    x = np.asarray(table["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES) if table.num_rows else np.zeros((0, N_FEATURES))
    y = np.asarray(table["quality"])
    order = np.argsort(np.asarray(table["doc_id"]), kind="stable")
    x, y = x[order], y[order]
    bad, good = x[y == 0], x[y == 1]
    neutral = np.log(cut / (1 - cut))
    if not len(bad) or not len(good):
        return QualityModel(np.zeros(N_FEATURES), neutral)
    weights = bradley_terry(good, bad, pairs)
    raw = np.sort(x @ weights)
    threshold = (raw[len(bad) - 1] + raw[len(bad)]) / 2  # the quantile of the share that the labels mark bad
    return QualityModel(weights, neutral - threshold)


def held_out(doc_id: str = "doc_id", parts: int = 4, rest: int = 2) -> Column:
    return F.coalesce(crc_of_id(doc_id) % parts == rest, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from the labels that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), model.column("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
