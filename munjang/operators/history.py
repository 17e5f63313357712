"""A bounded log of analyses as a table: (id, ts, kind, genre, level, score, after_score, band, n_chars, preview, text, result)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.functions.text import preview

#: Rows kept, and rows that a reader is shown.
KEPT, SHOWN = 500, 60


def without_repeats(rows: DataFrame, by: str = "id", key: str | None = None) -> DataFrame:
    """Rows that do not repeat text and kind of the row before them; blank texts go. With ``key`` each key is a log of its own; one log is worked on by ranges of ``by``."""
    if key is None:
        return _without_repeats_by_range(rows, by)
    now = F.struct("text", "kind")
    said = rows.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return said.withColumn("_last", F.lag(now).over(Window.partitionBy(key).orderBy(by))).where(F.col("_last").isNull() | (F.col("_last") != now)).drop("_last")


def newest(rows: DataFrame, n: int = KEPT, by: str = "id") -> DataFrame:
    """The n newest rows: each partition sends its own n at most."""
    return rows.orderBy(F.desc(by)).limit(n)


def _without_repeats_by_range(rows: DataFrame, by: str = "id") -> DataFrame:
    """``without_repeats`` of one log of any size: each range of ids looks back in itself, and its first row at the last one of the range before."""
    now = F.struct("text", "kind")
    said = rows.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = said.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    part = F.floor((F.col(by) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * ranges)
    dealt = said.crossJoin(F.broadcast(ends)).withColumn("_range", part).drop("_low", "_high")
    edges = dealt.groupBy("_range").agg(F.max_by(now, by).alias("_edge")).withColumn("_edge", F.lag("_edge").over(Window.orderBy("_range")))
    last = F.coalesce(F.lag(now).over(Window.partitionBy("_range").orderBy(by)), F.col("_edge"))
    marked = dealt.join(F.broadcast(edges), "_range").withColumn("_last", last)
    return marked.where(F.col("_last").isNull() | (F.col("_last") != now)).drop("_last", "_edge", "_range")


def append(log: DataFrame, new: DataFrame, kept: int = KEPT) -> DataFrame:
    """The log with new rows: blank texts and consecutive repeats dropped from all of them, previews made, then the newest kept."""
    both = newest(log, kept + 1).unionByName(new.withColumn("preview", preview("text")), allowMissingColumns=True)
    return newest(_without_repeats_by_range(both), kept)


def recent(log: DataFrame, n: int = SHOWN) -> DataFrame:
    return newest(log, n).drop("text", "result")


def get(log: DataFrame, id: int) -> DataFrame:
    return log.where(F.col("id") == id)


def delete(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids.select("id"), "id", "left_anti")


def stats(log: DataFrame) -> DataFrame:
    """Number of rows and mean score of detections."""
    return log.agg(F.count("*").alias("total"), F.round(F.avg(F.when(F.col("kind") == "detect", F.col("score"))), 1).alias("avg_score"))
