"""Document fingerprints: bottom-k sketches of word shingle hashes.

A fingerprint holds the k smallest hashes of a document's distinct 5-word
shingles (A-Z as a-z). The fingerprint of a union is made from the parts'
fingerprints alone, and resemblance, containment and the number of distinct
shingles are estimated from it; of fewer than k shingles they are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.kernels import U64, document_shingles

#: Hashes in a fingerprint, and the bits of a hash that are kept.
K, BITS = 128, 48


def sketch(shingle_hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes, on ``BITS`` bits."""
    return np.unique(shingle_hashes[: k + 8] >> U64(64 - BITS))[:k]


def sketches(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    return [sketch(x, k) for x in document_shingles(pa.array(texts, pa.large_string()))]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that lies in both. Two empty sets are alike, an empty and another are not."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = len(both) - int(twice.sum())
    if distinct <= k:
        return float(twice.sum()) / distinct
    edge = both[~np.append(False, twice)][k - 1]
    return float((both[1:][twice] <= edge).sum()) / k


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    shared_count = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared_count / distinct(a, k))


def text_of(a: np.ndarray) -> str:
    """A sketch as a string: base64 of its hashes, big-endian."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BITS // 8 :] = raw
    return out.view(">u8").reshape(-1).astype(U64)


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """At most n-1 ids that cut the documents into ranges of about equal size."""
    if n < 2:
        return []
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()[0]
    return sorted(set(cuts or []))


def _leaf(cuts: list[int], leaves: list[Column]) -> Column:
    """The leaf of the range an id lies in: a decision tree, so the work for a row is logarithmic."""
    if not cuts:
        return leaves[0]
    m = len(cuts) // 2
    return F.when(F.col("doc_id") <= cuts[m], _leaf(cuts[:m], leaves[: m + 1])).otherwise(_leaf(cuts[m + 1 :], leaves[m + 1 :]))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text) such that each document's next one (descending doc_id; the first after the last) follows it in its partition.

    Documents are dealt into ranges of ids. The first document of a range is
    also sent to the end of the range before it, marked ``extra``; the first of
    all to the end of the last. One shuffle of the texts; no global sort.
    """
    n = shared.partitions(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _ranges(docs, n)
    part = _leaf(cuts, [F.lit(i) for i in range(len(cuts) + 1)])
    tops = {r["part"]: r["top"] for r in docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    there = sorted(tops)
    # Descending: the range before is the next higher one; the highest's first follows the lowest's last.
    before = {p: there[(i + 1) % len(there)] for i, p in enumerate(there)}
    key = shared.partition_keys(docs.sparkSession, n)  # one range for each partition
    leaf = lambda p: F.struct(F.lit(key[p]).alias("part"), F.lit(tops.get(p)).cast("long").alias("top"), F.lit(key[before[p]] if p in before else None).cast("int").alias("before"))
    placed = docs.withColumn("at", _leaf(cuts, [leaf(p) for p in range(len(cuts) + 1)]))
    own = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("extra"))
    also = F.struct(F.col("at.before").alias("part"), F.lit(True).alias("extra"))
    dealt = placed.select("doc_id", "no_id", "text", F.explode(F.when(F.col("doc_id") == F.col("at.top"), F.array(own, also)).otherwise(F.array(own))).alias("at"))
    rows = dealt.select("at.part", "at.extra", "doc_id", "no_id", "text")
    return rows.repartition(n, "part").sortWithinPartitions("part", "extra", F.desc("doc_id"), "text")


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document: its fingerprint, and that of its edited text.

    The edited text's last floor(n_chars / 2) code points are the first as many
    (or all) of the next document. Null text counts as empty; the likeness of
    two texts without words is 1. Rows without a doc_id come after all others
    and keep their null; rows that share one are ordered by text, and each is a
    document. A single document is its own next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far, with its sketch
        for batch in batches:
            rows = [*zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "no_id", "text")), strict=True)]
            if not rows:
                continue
            have = [x[-1] for x in held] + sketches([r[4] for r in rows], k)
            rows = [x[0] for x in held] + rows
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
            edited = []
            for i in pairs:
                text, half = rows[i][4], len(rows[i][4]) // 2
                edited.append(text[: len(text) - half] + rows[i + 1][4][:half])
            changed = sketches(edited, k)
            columns = [
                pa.array([None if rows[i][3] else rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(rows[i][4]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([text_of(have[i]) for i in pairs], pa.string()),
                pa.array([text_of(x) for x in changed], pa.string()),
                pa.array([resemblance(have[i], x, k) for i, x in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([resemblance(have[i], have[i + 1], k) for i in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = [(rows[-1], have[-1])]

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
