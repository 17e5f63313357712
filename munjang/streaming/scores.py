"""Scoring and logging of document streams with the same projections as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from munjang.functions.text import preview
from munjang.operators.detect import fused, layers


def score_stream(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, score, band, confidence, n_chars) of a stream (doc_id, text, genre); stateless."""
    return fused(layers(docs), weights).select("doc_id", "score", "band", "confidence", "n_chars")


def log_stream(runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of runs (ts, kind, text, ...) without repeats of a text and kind within ``delay``; state is bounded by the watermark."""
    said = runs.where(F.trim("text") != "").withColumns({"preview": preview("text"), "_key": F.xxhash64("kind", "text")})
    return said.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def band_counts(scored: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Documents and mean score by band and event-time window of a scored stream (ts, band, score)."""
    return scored.withWatermark("ts", delay).groupBy(F.window("ts", window), "band").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
