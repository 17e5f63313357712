"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed lower-case words and word beginnings. On a bounded sample
of labelled documents, one of each group of near copies, those are kept that
tell the classes apart beyond chance; labelled toxic documents are graded by
how many of these they hold; and one weight vector with ordered thresholds is fitted:
P(grade >= k) = sigmoid(w x - threshold_k). The sum of these probabilities is
the expected severity. Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.kernels import U64, Words, document_shingles, slices, string_buffers
from munjang.llm.labelled import sample, sigmoid

#: Labelled documents of each class, bits of a hashed feature, features kept at most, grades of toxic documents.
PER_CLASS, BITS, FEATURES, GRADES = 1500, 20, 4096, 3
#: Beginnings of words, in bytes, that are features besides the word.
HEADS = (4, 5, 6)
#: The least log-likelihood ratio and log-odds of a feature: with a million features few pass these by chance.
LEAST_RATIO, LEAST_ODDS = 18.0, 2.5
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: their number, and document and feature of each occurrence."""
    data, offsets = string_buffers(column)
    for lo, hi in slices(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _BETWEEN)
        doc = np.repeat(np.arange(hi - lo), words.counts)
        hashes = words.hashes(True, *HEADS)
        ids = np.concatenate([(h ^ U64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(64 - BITS) for i, h in enumerate(hashes)]).astype(np.int64)
        yield hi - lo, np.tile(doc, len(hashes)), ids


@dataclass
class Ordinal:
    """``weights`` by feature (0 for those not kept) and rising ``thresholds``; a document's score adds w * log2(1 + count)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return sigmoid(score[:, None] - self.thresholds)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for n, doc, ids in features(column):
            used = self.weights[ids] != 0
            pair, count = np.unique(doc[used] << BITS | ids[used], return_counts=True)
            out.append(np.bincount(pair >> BITS, self.weights[pair & (1 << BITS) - 1] * np.log2(1.0 + count), n))
        return np.concatenate(out) if out else np.zeros(0)


def choose(doc: np.ndarray, ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose presence speaks for y = 1 beyond chance, by their log-likelihood ratio."""
    toxic = y[doc] == 1
    a, b = (np.bincount(ids[m], minlength=1 << BITS).astype(float) for m in (toxic, ~toxic))
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    part = lambda k, e: k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9))
    held, share = a + b, n1 / (n1 + n0)
    ratio = 2 * (part(a, held * share) + part(b, held * (1 - share)) + part(n1 - a, (n1 + n0 - held) * share) + part(n0 - b, (n1 + n0 - held) * (1 - share)))
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    # Words that clean documents hold more often say nothing about a toxic one.
    ratio[odds < LEAST_ODDS] = 0
    best = np.argsort(-ratio, kind="stable")[:FEATURES]
    return best[ratio[best] >= LEAST_RATIO]


def grade(load: np.ndarray, y: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean documents; toxic ones 1 to ``grades`` by quantile of their load of kept features."""
    out = np.zeros(len(y), np.int64)
    toxic = y == 1
    if toxic.any():
        cuts = np.unique(np.quantile(load[toxic], np.arange(1, grades) / grades))
        out[toxic] = 1 + np.searchsorted(cuts, load[toxic], side="left")
    return out


def fit(n: int, doc: np.ndarray, ids: np.ndarray, counts: np.ndarray, y: np.ndarray, grades: int = GRADES, rounds: int = 400) -> Ordinal:
    """Fit on n documents: (doc, feature id, count) and 0/1 labels."""
    kept = choose(doc, ids, y)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    used = place[ids] >= 0
    row, column, value = doc[used], place[ids[used]], np.log2(1.0 + counts[used])
    g = grade(np.bincount(row, value, n), y, grades)
    top = max(1, int(g.max(initial=0)))
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    w, first, gaps = np.full(len(kept), 0.5), np.array(1.0), np.zeros(top - 1)
    params = [w, first, gaps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):  # Adam on the log-likelihood; gaps between thresholds are exponentials
        score = np.bincount(row, value * params[0][column], n)
        steps = np.exp(params[2])
        thresholds = params[1] + np.append(0, np.cumsum(steps))
        cum = np.column_stack([np.ones(n), sigmoid(score[:, None] - thresholds), np.zeros(n)])
        p = np.maximum(cum[np.arange(n), g] - cum[np.arange(n), g + 1], 1e-9)
        slope = cum * (1 - cum)
        dscore = balance * (slope[np.arange(n), g] - slope[np.arange(n), g + 1]) / p
        dthreshold = np.zeros(top + 2)
        np.add.at(dthreshold, g, -balance * slope[np.arange(n), g] / p)
        np.add.at(dthreshold, g + 1, balance * slope[np.arange(n), g + 1] / p)
        dthreshold = dthreshold[1 : top + 1]
        grads = [np.bincount(column, value * dscore[row], len(kept)) / n - 1e-4 * params[0], dthreshold.sum() / n, dthreshold[::-1].cumsum()[::-1][1:] * steps / n]
        for i, d in enumerate(grads):
            m = 0.9 * moments[i][0] + 0.1 * d
            v = 0.999 * moments[i][1] + 0.001 * d * d
            moments[i] = (m, v)
            params[i] = params[i] + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[kept] = params[0]
    return Ordinal(weights, params[1] + np.append(0, np.cumsum(np.exp(params[2]))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ordinal:
    """The model from at most ``per_class`` labelled documents of each class of ``toxic``. Without labelled toxic documents nothing is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at = batch.column("y").to_numpy(), 0
            low = np.array([x[0] if len(x) else U64(0) for x in document_shingles(batch.column("text"))], U64).view(np.int64)
            for n, doc, ids in features(batch.column("text")):
                pair, count = np.unique(doc << BITS | ids, return_counts=True)
                cuts = np.cumsum(np.bincount(pair >> BITS, minlength=n))[:-1]
                own, often = np.split((pair & (1 << BITS) - 1).astype(np.int32), cuts), np.split(count.astype(np.int32), cuts)
                kinds = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(y[at : at + n].astype(np.int32)), pa.array(low[at : at + n]), pa.array(own, kinds), pa.array(often, kinds)], ["y", "low", "ids", "counts"])
                at += n

    picked = sample(docs.select("doc_id", "text"), labels, "toxic", per_class)
    got = picked.mapInArrow(run, "y int, low long, ids array<int>, counts array<int>").toPandas()
    # Near copies mostly share their smallest shingle hash; the words of a copied text are no evidence of anything.
    got = got.sort_values(["low", "y"], kind="stable").drop_duplicates(["y", "low"])
    y = got.y.to_numpy()
    if not (y == 1).any():
        return Ordinal(np.zeros(1 << BITS), np.array([20.0]))
    sizes = [len(x) for x in got.ids]
    return fit(len(y), np.repeat(np.arange(len(y)), sizes), np.concatenate(list(got.ids)).astype(np.int64), np.concatenate(list(got.counts)), y)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, p_toxic (P(grade >= 1)), severity (expected grade), grade (likeliest) and is_toxic (p_toxic >= 0.5) of every row.

    Null and empty texts have no features. Other columns are not read; a null
    doc_id stays null; repeated rows are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.at_least(sent.value.scores(batch.column("text")))
            each = np.column_stack([np.ones(len(p)), p]) - np.column_stack([p, np.zeros(len(p))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], ["doc_id", "p_toxic", "severity", "grade", "is_toxic"])

    return shared.texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, p_toxic double, severity double, grade int, is_toxic boolean")


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` does not call toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.at_least(sent.value.scores(batch.column("text")))[:, 0] < 0.5))

    return shared.texts(docs).mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
