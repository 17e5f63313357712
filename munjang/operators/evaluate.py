"""Evaluation of scores against labels: AUROC, thresholds at a false positive rate, and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.operators.detect import fused, layers, once

#: Bounds of the length slices, in characters; the last one is open.
LENGTHS = (0, 150, 400, 1000)
RATES = (0.01, 0.05, 0.10)


def length_slice(chars: Column | str) -> Column:
    c = F.col(chars) if isinstance(chars, str) else chars
    names = [f"{a}-{b}" if b else f"{a}+" for a, b in zip(LENGTHS, [*LENGTHS[1:], None], strict=True)]
    return F.when(c < LENGTHS[1], names[0]).when(c < LENGTHS[2], names[1]).when(c < LENGTHS[3], names[2]).otherwise(names[3])


def slices(scored: DataFrame) -> DataFrame:
    """Rows (slice, positive, score) of ``scored`` (positive, score, n_chars, genre): overall, by length, and by genre where there are several."""
    names = F.array(F.lit("overall"), F.concat(F.lit("length "), length_slice("n_chars")), F.concat(F.lit("genre "), F.col("genre")))
    rows = scored.select(F.explode(names).alias("slice"), F.col("positive").cast("int").alias("positive"), F.col("score").cast("double").alias("score")).where("slice IS NOT NULL AND score IS NOT NULL AND positive IS NOT NULL")
    return rows


def by_score(rows: DataFrame, key: str = "slice", steps: int = 256) -> DataFrame:
    """Positives and negatives of each distinct score, with those above it: a prefix sum over ``steps`` bands of a key's scores, then one within each band, so a key of very many scores is no single task."""
    counts = rows.groupBy(key, "score").agg(F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    ends = counts.groupBy(key).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    banded = counts.join(ends, key).withColumn("_band", F.floor((F.col("score") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12)) * steps)).drop("_low", "_high")
    higher = Window.partitionBy(key).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy(key, "_band").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    bands = bands.select(key, "_band", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(c) for c in ("_pos", "_neg")])
    above = Window.partitionBy(key, "_band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    both = banded.join(bands, [key, "_band"])
    return both.select(key, "score", "pos", "neg", *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0))).alias(f"{c}_above") for c in ("pos", "neg")])


def auroc(rows: DataFrame, key: str = "slice") -> DataFrame:
    """(key, n_human, n_ai, auroc): the share of pairs in which the positive scores higher, ties for half; 0.5 if a side is empty. No pairs are formed."""
    s = by_score(rows, key).groupBy(key).agg(F.sum("neg").alias("n_human"), F.sum("pos").alias("n_ai"), F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("wins"))
    return s.select(key, "n_human", "n_ai", F.coalesce(F.try_divide(F.col("wins").cast("double"), (F.col("n_human") * F.col("n_ai")).cast("double")), F.lit(0.5)).alias("auroc"))


def operating_points(rows: DataFrame, rates: tuple[float, ...] = RATES, key: str = "slice") -> DataFrame:
    """(key, target_fpr, threshold, tpr): just above the negative of rank floor(n * rate), from the top; 50 without negatives, 0 if all are allowed."""
    scores = by_score(rows, key)
    totals = scores.groupBy(key).agg(F.sum("neg").alias("n"), F.sum("pos").alias("p")).withColumn("target_fpr", F.explode(F.array(*map(F.lit, rates))))
    allowed = totals.withColumn("rank", F.floor(F.col("n") * F.col("target_fpr")))
    at = scores.join(allowed, key).where((F.col("neg_above") <= F.col("rank")) & (F.col("neg_above") + F.col("neg") > F.col("rank"))).select(key, "target_fpr", F.col("score").alias("edge"))
    points = allowed.join(at, [key, "target_fpr"], "left").withColumn("threshold", F.when(F.col("n") == 0, 50.0).when(F.col("rank") >= F.col("n"), 0.0).otherwise(F.col("edge") + 1e-9))
    caught = points.join(scores.select(key, "score", "pos"), key).groupBy(key, "target_fpr", "threshold").agg(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("pos")).otherwise(0)).alias("k"), F.sum("pos").alias("p"))
    return caught.select(key, "target_fpr", "threshold", F.coalesce(F.try_divide(F.col("k").cast("double"), F.col("p").cast("double")), F.lit(0.0)).alias("tpr"))


def summary(scored: DataFrame, rates: tuple[float, ...] = RATES) -> DataFrame:
    """One row for each slice: counts, AUROC, mean scores and operating points. Scores lie between 0 and 100 and are taken on one decimal place, as they are reported."""
    return _summed(slices(scored), rates)


def _summed(rows: DataFrame, rates: tuple[float, ...]) -> DataFrame:
    """One pass over the rows: a histogram of at most 1,001 scores for each slice, from which all figures follow within the row."""
    bins = rows.groupBy("slice", F.round("score", 1).alias("score")).agg(F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    each = F.struct((-F.col("score")).alias("down"), "score", "pos", "neg")
    held = bins.groupBy("slice").agg(F.array_sort(F.collect_list(each)).alias("h"), F.sum("neg").alias("n_human"), F.sum("pos").alias("n_ai"), *[F.sum(F.round(F.col("score") * 10).cast("long") * F.col(c)).alias(f"_{c}") for c in ("neg", "pos")])
    start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(0.0).alias("wins"))
    wins = F.aggregate("h", start, lambda a, x: F.struct((a["above"] + x["pos"]).alias("above"), (a["wins"] + x["neg"] * (a["above"] + x["pos"] / 2)).alias("wins")))["wins"]
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    n, p = F.col("n_human"), F.col("n_ai")

    def point(rate: float) -> Column:
        rank = F.floor(n * rate)
        none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("edge"))
        edge = F.aggregate("h", none, lambda a, x: F.struct((a["seen"] + x["neg"]).alias("seen"), F.when(a["edge"].isNull() & (a["seen"] + x["neg"] > rank), x["score"]).otherwise(a["edge"]).alias("edge")))["edge"]
        threshold = F.when(n == 0, 50.0).when(rank >= n, 0.0).otherwise(edge + 1e-9)
        caught = F.aggregate(F.filter("h", lambda x: x["score"] >= threshold), F.lit(0).cast("long"), lambda a, x: a + x["pos"])
        return F.struct(F.lit(rate).alias("target_fpr"), threshold.alias("threshold"), F.coalesce(share(caught, p), F.lit(0.0)).alias("tpr"))

    return held.select("slice", "n_human", "n_ai", F.coalesce(share(wins, n * p), F.lit(0.5)).alias("auroc"), share(F.col("_neg"), 10 * n).alias("mean_human"), share(F.col("_pos"), 10 * p).alias("mean_ai"), F.array(*map(point, rates)).alias("operating_points"))


def score_rows(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, positive, score, n_chars, genre) of labelled documents (doc_id, text, genre, label: 0 human, 1 machine)."""
    # Filters on the score stay above it: below, each would take the whole chain of expressions.
    return fused(layers(docs), weights).select("doc_id", F.col("label").cast("int").alias("positive"), once(F.col("score")).alias("score"), "n_chars", "genre")


def evaluation(scored: DataFrame, rewritten: DataFrame | None = None, rates: tuple[float, ...] = RATES) -> DataFrame:
    """One row for each slice as it is reported: counts, AUROC on 4 places, mean scores on 1, operating points. ``rewritten`` machine texts make the slice "adversarial", against the same human ones."""
    out = summary(scored, rates)
    if rewritten is not None:
        against = scored.where("positive = 0").select("positive", "score").unionByName(rewritten.where("positive = 1").select("positive", "score"))
        only = against.select(F.lit("adversarial").alias("slice"), F.col("positive").cast("int").alias("positive"), F.col("score").cast("double").alias("score"))
        out = out.unionByName(_summed(only, rates))
    points = F.transform("operating_points", lambda p: F.struct(p["target_fpr"].cast("double").alias("target_fpr"), F.round(p["threshold"], 2).alias("threshold"), F.round(p["tpr"], 4).alias("tpr")))
    return out.select("slice", "n_human", "n_ai", F.round("auroc", 4).alias("auroc"), F.round("mean_human", 1).alias("mean_human"), F.round("mean_ai", 1).alias("mean_ai"), points.alias("operating_points"))


def as_json(rows: DataFrame) -> DataFrame:
    """(slice, result): a reported slice as one JSON text."""
    return rows.select("slice", F.to_json(F.struct(*[c for c in rows.columns])).alias("result"))


def blocks(rows: DataFrame) -> DataFrame:
    """(slice, block): a reported slice as lines of text; a slice that lacks a side says so."""
    head = F.format_string("%s (human %d, machine %d)", "slice", "n_human", "n_ai")
    measures = F.format_string("  AUROC %.4f, mean score %.1f human, %.1f machine", "auroc", "mean_human", "mean_ai")
    points = F.transform("operating_points", lambda p: F.format_string("  TPR at FPR %.0f%% = %.1f%% (threshold %.1f)", p["target_fpr"] * 100, p["tpr"] * 100, p["threshold"]))
    body = F.when((F.col("n_human") == 0) | (F.col("n_ai") == 0), F.array(F.lit("  too few texts"))).otherwise(F.concat(F.array(measures), points))
    return rows.select("slice", F.array_join(F.concat(F.array(head), body), "\n").alias("block"))


def adversarial_drop(plain: DataFrame, rewritten: DataFrame, rate: float = RATES[0]) -> DataFrame:
    """tpr of the rows as they are, of rewritten positives at the same threshold, and the difference; both (positive, score)."""
    rows = plain.select(F.lit("all").alias("slice"), F.col("positive").cast("int").alias("positive"), "score")
    point = operating_points(rows, (rate,)).select("threshold", F.col("tpr").alias("tpr_overall"))
    again = rewritten.where("positive = 1").crossJoin(F.broadcast(point)).agg(F.first("tpr_overall").alias("tpr_overall"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("tpr_adversarial"))
    return again.withColumn("drop", F.col("tpr_overall") - F.col("tpr_adversarial"))
