"""Fitting the fusion weights and the metric baselines on a labelled corpus."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from munjang.operators.detect import METRICS, layers

LAYERS = ("l1", "l2", "l3", "l4")
#: Shortest document, fewest documents of a class or genre, strength of the ridge.
MIN_CHARS, MIN_DOCS, RIDGE = 150, 20, 1e-3


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, label, genre, l1..l4) of documents that are long enough; label is 0 for human and 1 for machine texts."""
    kept = docs.where(F.length("text") >= MIN_CHARS)
    return layers(kept).select("doc_id", "label", "genre", *LAYERS)


def class_means(rows: DataFrame) -> DataFrame:
    """(layer, human, machine, gap)."""
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(k).alias("v")) for k in LAYERS])).alias("x")).select("label", "x.*")
    means = long.groupBy("layer").agg(F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("human"), F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("machine"))
    return means.withColumn("gap", F.col("machine") - F.col("human"))


def fit(rows: DataFrame, ridge: float = RIDGE, min_docs: int = MIN_DOCS) -> dict[str, float]:
    """Weights of the four layers and the bias, by ridge logistic regression. A class with too few documents is an error."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < min_docs:
        raise ValueError(f"at least {min_docs} documents of each class are needed, not {counts}")
    ready = VectorAssembler(inputCols=list(LAYERS), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    model = LogisticRegression(regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=200).fit(ready)
    names = ("l1_calibrated_z", "l2_pattern_density", "l3_rhythm", "l4_human_evidence")
    return {k: round(float(w), 4) for k, w in zip(names, model.coefficients, strict=True)} | {"bias": round(float(model.intercept), 4)}


def metric_baselines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(genre, metric, mean, sd, n) of human documents, for genres with enough of them."""
    rows = layers(docs.where(F.length("text") >= MIN_CHARS)).select("genre", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"metrics.{k}").alias("v")) for k in (*METRICS, "ending_diversity", "declarative_ratio")])).alias("x")).select("genre", "x.*")
    return rows.groupBy("genre", "metric").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("sd"), F.count("*").alias("n")).where(F.col("n") >= min_docs)


def baseline_table(docs: DataFrame, source: str = "human documents") -> dict:
    """Metric baselines as a nested table: a few cells for each genre, so it fits the driver."""
    genres: dict[str, dict] = {}
    for r in sorted(metric_baselines(docs).collect(), key=lambda r: (r["genre"], r["metric"])):
        genres.setdefault(r["genre"], {})[r["metric"]] = {"mean": r["mean"], "stdev": r["sd"], "n": r["n"], "_placeholder": False}
    return {"version": "calibrated", "source": source, "genres": genres}


def run(docs: DataFrame, weights_path: str | None = None, baseline_path: str | None = None) -> tuple[dict, dict]:
    """Fit weights on labelled documents (doc_id, text, genre, label) and measure baselines on the human ones. Written as JSON text where paths are given, any that Spark writes; without them nothing is written."""
    rows = features(docs)
    weights = fit(rows)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    baseline = baseline_table(docs.where("label = 0"))
    for path, text in ((weights_path, weights_json(weights, counts)), (baseline_path, json.dumps(baseline, ensure_ascii=False, indent=2))):
        if path:
            docs.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return weights, baseline


def weights_json(weights: dict[str, float], counts: dict[int, int] | None = None) -> str:
    known = {"_n_human": counts.get(0, 0), "_n_ai": counts.get(1, 0)} if counts else {}
    return json.dumps(weights | {"_fitted": True} | known, ensure_ascii=False, indent=2)


def read_weights(text: str | None) -> dict[str, float] | None:
    """Weights of a JSON text; None where it is missing or no such text."""
    try:
        found = json.loads(text or "")
        return {k: float(v) for k, v in found.items() if not k.startswith("_")} if isinstance(found, dict) else None
    except (ValueError, TypeError):
        return None
