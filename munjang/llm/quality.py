"""Quality classifier by co-training of a text view and a metadata view.

The text view is a logistic regression on statistics of the whole text; the
metadata view one on language, source and length. Both are fitted on a bounded
sample of labelled documents. In each round every view labels the documents of
a bounded unlabelled pool it is confident about, as many of each class as the
classes' shares allow, and hands them to the other view. At last each view is
calibrated on held-out labelled documents, and a third regression weighs the
two calibrated log-odds. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.kernels import Words, grams, slices, string_buffers
from munjang.llm.labelled import held_out, logistic, logits, sample, sigmoid

#: Labelled documents of each class, unlabelled documents in the pool, rounds, least confidence of a pseudo-label, documents a view hands over in a round.
PER_CLASS, POOL, ROUNDS, CONFIDENT, HANDED = 2000, 4000, 4, 0.95, 400
_SETS = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "stop": [0x2E, 0x2C, 0x3B, 0x3A, 0x3F],
    "mark": [x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x not in (0x2E, 0x2C, 0x3B, 0x3A, 0x3F)],
    "high": [*range(0x80, 0x100)],
    "line": [0x0A],
}
_MASKS = {k: np.isin(np.arange(256), v) for k, v in _SETS.items()}
#: Hash slots of a language or source, and number of text statistics.
_SLOTS, TEXT_FEATURES = 32, 13


def text_features(column: pa.Array) -> np.ndarray:
    """Statistics of each text: shares of character classes, words, repeats of words and of five-word runs, and whether some of them are far out."""
    data, offsets = string_buffers(column)
    out = []
    for lo, hi in slices(offsets):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words = Words(own, at)
        hashes = words.hashes(True)
        size = np.maximum(np.diff(at), 1).astype(float)
        n = np.maximum(words.counts, 1).astype(float)
        sums = {}
        for name, mask in _MASKS.items():
            total = np.append(0, np.cumsum(mask[own]))
            sums[name] = np.diff(total[at]).astype(float)
        letters = np.maximum(sums["upper"] + sums["lower"], 1)
        same = np.append(0, np.cumsum(np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]))
        run = np.maximum(np.diff(same[words.first]), 0)
        five = grams(hashes, 5)
        again = np.zeros(hi - lo)
        for i, (a, k) in enumerate(zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True)):
            if k >= 6:
                again[i] = 1 - len(np.unique(five[a : a + k - 4])) / (k - 4)
        upper, mark, once = sums["upper"] / letters, sums["mark"] / n, run / n
        out.append(
            np.column_stack(
                [
                    upper > 0.7,
                    mark > 0.4,
                    once > 0.3,
                    again > 0.6,
                    sums["upper"] / letters,
                    np.sqrt(sums["mark"] / n),
                    np.sqrt(sums["digit"] / size),
                    sums["stop"] / n,
                    sums["high"] / size,
                    sums["line"] / n,
                    np.log1p(size / n),
                    np.sqrt(run / n),
                    np.sqrt(again),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, TEXT_FEATURES))


def metadata_features(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed language and source, and logarithm of the length; null counts as a value of its own."""
    n = batch.num_rows
    out = np.zeros((n, 2 * _SLOTS + 2))
    for k, name in enumerate(("lang", "source")):
        slot = np.array([hash_name(x) for x in batch.column(name).to_pylist()], np.int64)
        out[np.arange(n), k * _SLOTS + slot] = 1
    size = np.array([x if x is not None and x > 0 else 0 for x in batch.column("n_chars").to_pylist()], float)
    out[:, -2] = np.log1p(size) / 5
    out[:, -1] = (np.log1p(size) / 5) ** 2
    return out


def hash_name(value: str | None) -> int:
    out = 7
    for b in (value or "").encode():
        out = (out * 131 + b) % 1_000_003
    return 0 if value is None else 1 + out % (_SLOTS - 1)


@dataclass
class View:
    """A standardised logistic regression and its calibration (slope, intercept)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return logits((x - self.mean) / self.scale, self.weights)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


@dataclass
class Quality:
    text: View
    metadata: View
    blend: np.ndarray

    def probability(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        return sigmoid(logits(np.column_stack([self.text.calibrated(text), self.metadata.calibrated(metadata)]), self.blend))


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return View(mean, scale, logistic((x - mean) / scale, y, weight))


def co_train(views: list[np.ndarray], y: np.ndarray, ids: np.ndarray, pool: list[np.ndarray], base: float) -> Quality:
    """``views``: both views' features of the labelled documents, ``pool``: of the unlabelled ones; ``base``: share of good documents among all labels.

    The sample is balanced; weights put the classes back to their shares.
    """
    weight = np.where(y == 1, base / max(1e-9, (y == 1).mean()), (1 - base) / max(1e-9, (y == 0).mean()))
    test = held_out(ids)
    if len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test = np.zeros(len(y), bool)
    train = ~test
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has received
    models: list[View] = []
    for _ in range(ROUNDS + 1):
        models = []
        for k in (0, 1):
            rows = np.array(sorted(given[k]), np.int64)
            x = np.concatenate([views[k][train], pool[k][rows]]) if len(rows) else views[k][train]
            labels = np.concatenate([y[train], [given[k][i] for i in rows.tolist()]])
            models.append(fit_view(x, labels, np.concatenate([weight[train], np.ones(len(rows))])))
        for k in (0, 1):
            if not len(pool[k]):
                continue
            p = sigmoid(models[k].raw(pool[k]))
            for label, sure, share in ((1.0, p, base), (0.0, 1 - p, 1 - base)):
                order = np.argsort(-sure, kind="stable")[: max(1, round(HANDED * share))]
                given[1 - k].update((i, label) for i in order[sure[order] >= CONFIDENT].tolist())
    cal = test if test.any() else train
    for k in (0, 1):
        w = logistic(models[k].raw(views[k][cal])[:, None], y[cal], weight[cal], ridge=0.1)
        models[k].slope, models[k].shift = float(max(w[0], 0.0)), float(w[1])
    both = np.column_stack([models[k].calibrated(views[k][cal]) for k in (0, 1)])
    return Quality(models[0], models[1], logistic(both, y[cal], weight[cal], ridge=0.1))


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, pool: int = POOL) -> Quality | None:
    """The model from bounded samples; None where the labels do not hold both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = text_features(batch.column("text")), metadata_features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.float64()))], ["doc_id", "y", "x", "m"])

    docs = _needed(docs)
    counts = {r["quality"]: r["n"] for r in labels.where("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    known = sample(docs, labels, "quality", per_class).select(*docs.columns, F.col("y").cast("int").alias("y"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool)
    other = docs.join(F.broadcast(ids.distinct()), "doc_id").select(*docs.columns, F.lit(-1).alias("y"))
    got = known.unionByName(other).mapInArrow(run, "doc_id long, y int, x array<double>, m array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    if len(set(got.y[got.y >= 0])) < 2:
        return None
    parts = [got[got.y >= 0], got[got.y < 0]]
    stack = lambda part, c, width: np.stack(part[c].to_numpy()) if len(part) else np.zeros((0, width))
    views, spare = ([stack(p, "x", TEXT_FEATURES), stack(p, "m", 2 * _SLOTS + 2)] for p in parts)
    return co_train(views, parts[0].y.to_numpy(float), parts[0].doc_id.to_numpy(), spare, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Quality | None) -> DataFrame:
    """doc_id, p_text, p_metadata (calibrated views), p_quality (both) and keep (p_quality >= 0.5) of every row.

    Without a model every probability is null and every row is kept. Null and
    empty texts have all statistics 0; null language, source and length are
    values of their own; a null doc_id stays null; repeated rows are scored each.
    """
    schema = "doc_id long, p_text double, p_metadata double, p_quality double, keep boolean"
    docs = _needed(docs)
    if model is None:
        return docs.selectExpr("doc_id", "cast(NULL AS double) AS p_text", "cast(NULL AS double) AS p_metadata", "cast(NULL AS double) AS p_quality", "true AS keep")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = text_features(batch.column("text")), metadata_features(batch)
            p = sent.value.probability(x, m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(sent.value.text.calibrated(x))), pa.array(sigmoid(sent.value.metadata.calibrated(m))), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "p_text", "p_metadata", "p_quality", "keep"])

    return shared.texts(docs).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Quality | None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` keeps."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.probability(text_features(batch.column("text")), metadata_features(batch)) >= 0.5))

    return shared.texts(docs).mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
