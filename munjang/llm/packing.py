"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Whatever the number of documents, only the histogram of piece lengths (one
count for each length up to the sequence length) reaches the driver. The
packing is planned on it: a sequence is filled greedily, longest piece first;
then its smallest piece gives way to two unpacked pieces that fill the freed
room more tightly. A plan entry stands for as many equal sequences as the
counts allow, so there are a few entries for each length. Pieces are numbered within their
length by counts per task and a prefix sum, and look up their place in the
broadcast plan, whose size is bounded by the sequence length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.llm import shared
from munjang.llm.wordbpe import WordTokens

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokens(path: str | None = None) -> WordTokens:
    return WordTokens(path or public_tokenizers.path(VOCABULARY))


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, with the task that made each and its number among that task's pieces of its length. To be written before it is read twice: the numbers belong to one run of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, seen = word_tokens(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs = iter(batch.column("doc_id").to_pylist())
            for ids, ends in tokens.columns(batch.column("text")):
                raw = memoryview(ids.astype("<u4").tobytes())
                rows: list[tuple] = []
                for doc, a, b in zip(islice(docs, len(ends) - 1), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    total = b - a + 1
                    for k, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + start + length, b)])
                        if start + length == total:
                            crc = zlib.crc32(END, crc)
                        rows.append((doc, k, start, length, crc, task, int(seen[length])))
                        seen[length] += 1
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return shared.texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long")


def best_two(lengths: list[int], counts: list[int], room: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is largest, over ``above`` and at most ``room``; two of one length if there are two."""
    unpacked = [(k, n) for k, n in zip(lengths, counts, strict=True) if n and k <= room]
    best, found, i, j = above, None, 0, len(unpacked) - 1
    while i < j or i == j and unpacked[i][1] > 1:
        total = unpacked[i][0] + unpacked[j][0]
        if total > room:
            j -= 1
            continue
        if total > best:
            best, found = total, (unpacked[i][0], unpacked[j][0])
        i += 1
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, how many pieces of each length in one of them), until every piece is packed."""
    lengths = sorted(k for k, v in histogram.items() if v)
    left = {k: histogram[k] for k in lengths}
    out = []
    while lengths:
        use: Counter[int] = Counter()
        gap, at = capacity, len(lengths) - 1
        while gap > 0 and (at := min(at, bisect_right(lengths, gap) - 1)) >= 0:
            k = lengths[at]
            if n := min(left[k] - use[k], gap // k):
                use[k] += n
                gap -= n * k
            at -= 1
        if gap and sum(use.values()) > 1:
            small = min(use)
            use[small] -= 1
            free = [left[k] - use[k] for k in lengths]
            at = lengths.index(small)
            if two := best_two(lengths, [n - (i == at) for i, n in enumerate(free)], gap + small, small):
                use.update(two)
            else:
                use[small] += 1
            use += Counter()
        times = min(left[k] // n for k, n in use.items())
        out.append((times, dict(use)))
        for k, n in use.items():
            left[k] -= times * n
        lengths = [k for k in lengths if left[k]]
    return out


def places(planned: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and run of piece numbers: the first sequence, pieces a sequence and first offset; sorted by (length, first number)."""
    rows, taken, sequence = [], Counter(), 0
    for times, use in planned:
        offset = 0
        for k in sorted(use, reverse=True):
            rows.append((k, taken[k], use[k], sequence, offset))
            taken[k] += times * use[k]
            offset += k * use[k]
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "first", "each", "sequence", "offset"))}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the end id alone; repeated rows are
    packed as often as they occur; a null doc_id stays null; no documents give
    no rows. Documents longer than a sequence are cut at multiples of its length.
    """
    made = shared.save(pieces(docs, vocabulary, capacity), "pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    step = 1 + max(histogram.values(), default=0)
    key = table["length"] * step + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length * step + number, side="right") - 1
            past = number - table["first"][at]
            sequence = table["sequence"][at] + past // table["each"][at]
            offset = table["offset"][at] + past % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
