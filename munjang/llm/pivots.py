"""Exact top-k inner product search by elimination with a table of pivot distances.

Distances of all vectors to a fixed set of pivots are computed once and saved
beside the vectors. For a query q and a candidate v every pivot p bounds their
distance from below by |d(q,p) - d(v,p)|, hence the inner product from above
by (|q|^2 + |v|^2 - bound^2) / 2. Candidates are scored in the order of that
bound, in runs, until no bound reaches the k-th best score so far: exact
whatever the data. Components are integers and scores are exact integers: in
doubles where no sum can pass 2**53, in longs where none can pass 2**63, else
in Python's integers.

Queries are taken in blocks of bounded bytes, one after another; a block is
broadcast and meets every partition of the table, which returns its own k best
for each query; these are merged by query, and a block's results are written
before the next begins. The rows between are at most k for each query and
partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.llm import shared

SCALE, K, PIVOTS, RUN = 1024, 10, 24, 512
#: Queries of a block and their bytes at most, and vectors that pivots are chosen from.
QUERY_BLOCK, BLOCK_BYTES, SAMPLE = 16_384, 32 << 20, 4096
#: Candidates that a task looks at together.
PART = 16_384
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors as doubles; those that are null, empty or hold a null or non-finite component, and null ids, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension that occurs."""
    flat = column.flatten().to_numpy()
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    return [(rows, flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist() for rows in (np.flatnonzero(sizes == d),)]


def whole(x: np.ndarray) -> np.ndarray:
    """Components floor(SCALE * x) as doubles, which hold them exactly (or as infinities)."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def integers(x: np.ndarray) -> np.ndarray:
    """The same as Python integers, whatever their size."""
    return np.array([[math.floor(c) * SCALE if abs(c) >= 2**53 else math.floor(c * SCALE) for c in row] for row in x.tolist()], object).reshape(x.shape)


def products(x: np.ndarray, v: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact inner products of rows v = whole(x) with w = whole(q) as longs; what a long cannot hold is its nearest end."""
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(v).max(initial=0)
        most = largest * np.abs(w).sum()
    if most < 2**53:
        return (v @ w).astype(np.int64)
    if most < 2**62 and largest < 2**62:
        return v.astype(np.int64) @ w.astype(np.int64)
    return np.array([min(max(s, LEAST), MOST) for s in (integers(x) @ integers(q[None])[0]).tolist()], np.int64)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the point furthest from those chosen before it."""
    points = points[np.abs(points).max(1) < 1e150]
    if not len(points):
        return points
    chosen = [int(np.argmax((points**2).sum(1)))]
    away = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T), 0))


def bounds(norm: float, near: np.ndarray, norms: np.ndarray, nears: np.ndarray) -> np.ndarray:
    """The largest possible inner product of a query with each candidate, by square norms and pivot distances. Rounding is allowed for; where numbers overflow there is no bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        below = np.abs(nears - near).max(1, initial=0)
        out = (norm + norms - below**2) / 2
        out += 1e-6 * (norm + norms) + 1
    out[~np.isfinite(out)] = np.inf
    return out


class Best:
    """The k best of a query among the candidates that a task has seen."""

    def __init__(self, x: np.ndarray, near: np.ndarray, k: int):
        self.x, self.v, self.near, self.k = x, whole(x), near, k
        with np.errstate(over="ignore"):
            self.norm = float((self.v**2).sum())
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        """Candidates bounded below this cannot be among the k best."""
        return float(self.scores[-1]) if len(self.scores) == self.k and self.scores[-1] > LEAST else -np.inf

    def meet(self, own: int, ids: np.ndarray, x: np.ndarray, v: np.ndarray, norms: np.ndarray, nears: np.ndarray) -> None:
        """Score the candidates, highest bound first, until no bound reaches the k-th best; the query's own id takes no part."""
        bound = bounds(self.norm, self.near, norms, nears)
        left = np.flatnonzero((bound >= self.floor()) & (ids != own))
        if len(left) > RUN:  # sorting can wait for the k-th best of the highest bounds
            top = np.argpartition(-bound[left], RUN)
            self._score(ids, x, v, left[top[:RUN]])
            left = left[top[RUN:]]
            left = left[bound[left] >= self.floor()]
        left = left[np.argsort(-bound[left], kind="stable")]
        for a in range(0, len(left), RUN):
            if bound[left[a]] < self.floor():
                break
            self._score(ids, x, v, left[a : a + RUN])

    def _score(self, ids: np.ndarray, x: np.ndarray, v: np.ndarray, rows: np.ndarray) -> None:
        scores, ids = np.append(self.scores, products(x[rows], v[rows], self.x, self.v)), np.append(self.ids, ids[rows])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def pivot_table(ready: DataFrame, n_pivots: int) -> DataFrame:
    """(vec_id, x, near): vectors with their distances to the pivots of their dimension, saved. Pivots come from a bounded sample; a dimension that it lacks has none."""
    sample = ready.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    column = sample["x"].combine_chunks() if isinstance(sample["x"], pa.ChunkedArray) else sample["x"]
    sent = ready.sparkSession.sparkContext.broadcast({x.shape[1]: spread(whole(x), n_pivots) for _, x in matrix(column)} if len(sample) else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list = [[]] * batch.num_rows
            for rows, x in matrix(batch.column("x")):
                if x.shape[1] in sent.value:
                    for i, d in zip(rows.tolist(), distances(whole(x), sent.value[x.shape[1]]), strict=True):
                        near[i] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.float64()))], ["vec_id", "x", "near"])

    return shared.save(ready.mapInArrow(run, "vec_id long, x array<double>, near array<double>"), "pivot-table")


def _block(rows: pa.Table, k: int) -> dict[int, list[tuple[int, int, Best]]]:
    """(number, id, search) of the queries of a block by dimension."""
    out: dict[int, list] = {}
    for n, (q_id, x, near) in enumerate(zip(*(rows[c].to_pylist() for c in ("vec_id", "x", "near")), strict=True)):
        out.setdefault(len(x), []).append((n, q_id, Best(np.array(x), np.array(near), k)))
    return out


def top_k(vectors: DataFrame, every: int = 100, k: int = K, n_pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every``, the k others of largest integer inner product, ties to the smaller id.

    Vectors of different dimension do not meet. Repeated rows of one vec_id are
    candidates each, and queries once for each distinct vector. No vectors or
    no queries give no rows; fewer than k others give all. Scores that a long
    cannot hold are its nearest end, and equal there.
    """
    spark = vectors.sparkSession
    table = pivot_table(finite_vectors(vectors), n_pivots)
    asked = table.where(F.col("vec_id") % every == 0).distinct()
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("x") + F.size("near")).alias("width")).first()
    blocks = -(-size["n"] // max(1, min(query_block, BLOCK_BYTES // (8 * (size["width"] or 1)))))
    path = shared.path(spark, "top-k")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = _block(sent.value, k)
            for batch in batches:
                for a in range(0, batch.num_rows, PART):
                    part = batch.slice(a, PART)
                    ids = part.column("vec_id").to_numpy()
                    nears = part.column("near")
                    for rows, x in matrix(part.column("x")):
                        if x.shape[1] not in queries:
                            continue
                        v = whole(x)
                        with np.errstate(over="ignore"):
                            norms = (v**2).sum(1)
                        near = np.array(nears.take(pa.array(rows)).to_pylist(), float).reshape(len(rows), -1)
                        for _, q_id, best in queries[x.shape[1]]:
                            best.meet(q_id, ids[rows], x, v, norms, near)
            got = [x for of_size in queries.values() for x in of_size]
            each = [len(best.ids) for _, _, best in got]
            number, asked_ids = (np.repeat(np.array([x[i] for x in got], np.int64), each) for i in (0, 1))
            found = [np.concatenate([np.zeros(0, np.int64), *(getattr(best, c) for _, _, best in got)]) for c in ("ids", "scores")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, asked_ids, *found)], ["number", "query_id", "vec_id", "score"])

        best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        found = table.mapInArrow(run, "number long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return found
        found.write.mode("append").parquet(path)
        sent.destroy()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
