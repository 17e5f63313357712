"""Removal of repeated word sequences, found through fixed-block anchors.

A window of W consecutive words of one document is removed where its word
sequence also starts in a document with a smaller id. Any such window holds a
whole block of B = (W + 1) // 2 words that starts at a multiple of B in the
other document. So the index holds only the non-overlapping blocks, every
rolling run of B words probes it, and hits are extended to whole windows.

1. Tasks send sorted runs of truncated hashes, of blocks and of probes, to
   ranges of the hash space. A range finds the block hashes that occur more
   than once and returns them as its slice of a bitmap of fixed size.
2. With the bitmap broadcast, tasks keep the windows that hold a hit. A
   window's copies within one task are settled there; of each distinct window
   only those of the task's smallest document go on, so a passage that a third
   of all documents share costs one entry for each task. Ranges of the hash
   space find the smallest document of each window over all tasks.
3. Marked windows and texts meet by document. Hits that follow each other are
   extended to maximal repeats, whose words are dropped.

The bitmap only thins out work: where it fills up, more windows go to step 2,
and results stay the same. Windows are compared by 96 bits of hash across
documents, and a document's own windows by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.llm import shared
from munjang.llm.kernels import U64, Words, grams, pack, pack_sorted, second_grams, slices, string_buffers, unpack, unpack_sorted

WINDOW = 13
#: Bits of the anchor bitmap (16 MB), and words that a task works on at a time.
FILTER_BITS, RUN_WORDS = 27, 4_000_000


def _runs(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Runs of texts of bounded size: first and last row, words and word hashes."""
    data, offsets = string_buffers(column)
    for lo, hi in slices(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, words, words.hashes(False)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Words, np.ndarray]]:
    """The ids, words and word hashes of runs of documents."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for lo, hi, words, hashes in _runs(batch.column("text")):
            yield ids[lo:hi], words, hashes


def _whole(words: Words, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first m words: which start a run of n words within their document; the document (in this part) and place of each."""
    doc = np.repeat(np.arange(len(words.counts)), words.counts)[:m]
    place = np.arange(m) - words.first[:-1][doc]
    return place + n <= words.counts[doc], doc, place


def hash_bits(n_docs: int) -> int:
    """Bits of a truncated anchor hash: rows of a large corpus keep about the same share of chance hits as those of a small one."""
    return min(56, max(40, n_docs.bit_length() + 22))


def anchors(texts: DataFrame, block: int, bits: int, ranges: int, filter_bits: int) -> np.ndarray:
    """The bitmap, indexed by a hash's top ``filter_bits`` bits, of block hashes that occur at least twice at all."""
    top = ranges.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            v = np.concatenate(held)
            held.clear()
            v.sort()
            v = v[np.append(np.ones(min(2, len(v)), bool), v[2:] != v[:-2])]  # two of a kind tell as much as more
            edges = np.searchsorted(v, np.arange(ranges, dtype=U64) << U64(bits + 1 - top)) if top else np.array([0])
            edges = np.append(edges, len(v))
            full = np.flatnonzero(np.diff(edges)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack_sorted(v[edges[i] : edges[i + 1]]) for i in full], pa.binary())], ["part", "blob"])

        for _, words, hashes in _parts(batches):
            h = grams(hashes, block)
            ok, _, place = _whole(words, block, len(h))
            aligned = (place % block == 0).astype(U64)
            held.append((((h >> U64(64 - bits)) << U64(1)) | aligned)[ok])
            size += len(held[-1])
            if size >= RUN_WORDS:
                yield flush()
                size = 0
        if held:
            yield flush()

    width = 1 << (filter_bits - top)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in shared.by_group(batches, "part"):
            v = np.concatenate([unpack_sorted(x.as_py()) for x in table["blob"]])
            v.sort()
            h = v >> U64(1)
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(start, len(h)))
            block_too = np.maximum.reduceat(v & U64(1), start) == 1
            found = h[start[(count > 1) & block_too]]
            slot = np.zeros(width, np.uint8)
            slot[(found >> U64(bits - filter_bits)).astype(np.int64) - int(part) * width] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([np.packbits(slot).tobytes()], pa.binary())], ["part", "blob"])

    sent = texts.mapInArrow(send, "part int, blob binary").repartition(shared.partitions(texts.sparkSession), "part").sortWithinPartitions("part")
    bitmap = np.zeros((ranges, max(1, width // 8)), np.uint8)
    for row in sent.mapInArrow(settle, "part int, blob binary").collect():  # 2**filter_bits bits in all, whatever the input
        bitmap[row["part"]] = np.frombuffer(row["blob"], np.uint8)
    return bitmap.reshape(-1)


def _marked(ids: np.ndarray, w: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Marked windows, as document and window hash, in one blob for each group of documents."""
    group = group_of(ids, groups)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[g] : cuts[g + 1]]
        yield g, pack(ids[rows]) + pack(w[rows])


def _unmark(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(blob) // 2
    return unpack(blob[:half], np.int64), unpack(blob[half:], U64)


def _firsts(w: np.ndarray, more: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows in order, each once for a document, and which of them a smaller document has too."""
    order = np.lexsort((doc_id, more, w))
    w, more, doc_id = w[order], more[order], doc_id[order]
    first = np.append(True, (w[1:] != w[:-1]) | (more[1:] != more[:-1]))[: len(w)]
    once = first | np.append(True, doc_id[1:] != doc_id[:-1])[: len(w)]
    w, more, doc_id, first = w[once], more[once], doc_id[once], first[once]
    later = doc_id > doc_id[np.flatnonzero(first)][np.cumsum(first) - 1]
    return w, more, doc_id, later


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """Group of a document, as ``_group`` computes it in the JVM."""
    return (ids ^ (ids >> 17) ^ (ids >> 34)) % groups


def _group(groups: int) -> Column:
    x = F.col("doc_id")
    known = x.bitwiseXOR(F.shiftright(x, 17)).bitwiseXOR(F.shiftright(x, 34))
    return F.pmod(F.coalesce(known, F.xxhash64("text")), F.lit(groups)).cast("int")


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(blob[:8], "little")
    return unpack_sorted(blob[8 + 12 * n :]), unpack(blob[8 : 8 + 4 * n], np.uint32), unpack(blob[8 + 4 * n : 8 + 12 * n], np.int64)


def windows(texts: DataFrame, window: int, block: int, bits: int, filter_bits: int, ranges: int, groups: int, bitmap: np.ndarray) -> DataFrame:
    """Marked windows: rows (part, blob) by group of documents."""
    top = ranges.bit_length() - 1
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, more, doc_id, later = _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            out = [(1, g, blob) for g, blob in _marked(doc_id[later], w[later], groups)]
            w, more, doc_id = w[~later], more[~later], doc_id[~later]
            edges = np.searchsorted(w, np.arange(ranges, dtype=U64) << U64(64 - top)) if top else np.array([0])
            edges = np.append(edges, len(w))
            for g in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[g], edges[g + 1]
                out.append((0, g, int(b - a).to_bytes(8, "little") + pack(more[a:b]) + pack(doc_id[a:b]) + pack_sorted(w[a:b])))
            kind, part, blob = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "blob"])

        for ids, words, hashes in _parts(batches):
            h = grams(hashes, block)
            ok, _, _ = _whole(words, block, len(h))
            at = (h >> U64(64 - filter_bits)).astype(np.int64)
            hit = ok & ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            w = grams(hashes, window)
            ok, doc, _ = _whole(words, window, len(w))
            total = np.append(0, np.cumsum(hit))
            # A window has window - block + 1 rolling runs.
            reach = total[np.arange(len(w)) + window - block + 1] - total[np.arange(len(w))]
            keep = np.flatnonzero(ok & (reach > 0))
            held.append((w[keep], second_grams(hashes, keep, window), ids[doc[keep]]))
            size += len(keep)
            if size >= RUN_WORDS // 2:
                yield flush()
                size = 0
        if held:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(_marked(*(np.concatenate(x) for x in zip(*found, strict=True)), groups))
            found.clear()
            part, blob = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

        for _, table in shared.by_group(batches, "part"):
            kind = table["kind"].to_numpy()
            done = table.filter(pa.array(kind == 1)).select(["part", "blob"])
            yield from done.to_batches()
            asked = table.filter(pa.array(kind == 0))["blob"]
            if not len(asked):
                continue
            w, _, doc_id, later = _firsts(*(np.concatenate(x) for x in zip(*(_opened(b.as_py()) for b in asked), strict=True)))
            found.append((doc_id[later], w[later]))
            size += int(later.sum())
            if size >= RUN_WORDS:
                yield flush()
                size = 0
        if found:
            yield flush()

    # Marks that a task could settle travel with the open windows, so the texts are looked at once and nothing is kept besides.
    n = shared.partitions(texts.sparkSession)
    looked = texts.mapInArrow(look, "kind int, part int, blob binary").repartition(n, "part").sortWithinPartitions("part")
    return looked.mapInArrow(settle, "part int, blob binary")


def keep_mask(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which words stay when the windows that start at ``places`` go."""
    step = np.zeros(n_words + window + 1, np.int64)
    places = np.unique(places)
    step[places] += 1
    step[places + window] -= 1
    return np.cumsum(step)[:n_words] == 0


def spans(keep: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of words that go."""
    edge = np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge < 0).tolist(), np.flatnonzero(edge > 0).tolist()
    return [{"start": a, "length": b - a} for a, b in zip(first, last, strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS, columns: tuple[str, ...] = (), with_repeats: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text, and ``columns`` of docs; ``with_repeats`` also repeats, the first word and length of each maximal repeat.

    Words are runs of other than ASCII white space, unchanged; kept words are
    joined by one space. Null, empty and short texts lose nothing. Windows are
    judged on the input. Rows without a doc_id neither lose words nor cause a
    loss; repeated rows are alike, as no document is smaller than itself, and
    different texts of one doc_id are parts of one document.
    """
    spark = docs.sparkSession
    texts = shared.texts(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    block = (window + 1) // 2
    bits = max(hash_bits(docs.count()), filter_bits)
    ranges = 1 << max(0, (4 * shared.partitions(spark) - 1).bit_length())
    ranges = min(ranges, 1 << (filter_bits - 3))
    groups = shared.partitions(spark) + 1
    bitmap = anchors(texts, block, bits, ranges, filter_bits)
    marked = windows(texts, window, block, bits, filter_bits, ranges, groups, bitmap)
    taken = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *taken).withColumn("part", _group(groups))
    met = rows.withColumns({"kind": F.lit(1), "blob": F.lit(None).cast("binary")}).unionByName(marked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    met = met.repartition(shared.partitions(spark), "part").sortWithinPartitions("part", "kind")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, marks = None, [], None
        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    now, blobs, marks = part[a], [], None
                run = batch.slice(a, b - a)
                if not kind[a]:
                    blobs += [_unmark(x.as_py()) for x in run.column("blob")]
                    continue
                if marks is None:
                    ids, w = (np.concatenate(x) for x in zip(*blobs, strict=True)) if blobs else (np.zeros(0, np.int64), np.zeros(0, U64))
                    order = np.lexsort((w, ids))
                    marks, blobs = (ids[order], w[order]), []
                yield apply_marks(run, marks)

    def apply_marks(run: pa.RecordBatch, marks: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ids = run.column("doc_id").to_pylist()
        known = np.array([x or 0 for x in ids], np.int64)
        lo, hi = np.searchsorted(marks[0], known), np.searchsorted(marks[0], known, side="right")
        n_words, n_removed, kept, gone = [], [], [], []
        for a, b, words, hashes in _runs(run.column("text")):
            w = grams(hashes, window)
            at = words.offsets.tolist()
            for k, (i, first, n) in enumerate(zip(range(a, b), words.first[:-1].tolist(), words.counts.tolist(), strict=True)):
                own = words.data[at[k] : at[k + 1]].tobytes().split()
                keep = np.ones(n, bool)
                if n >= window and ids[i] is not None and lo[i] < hi[i]:
                    marked, mine = marks[1][lo[i] : hi[i]], w[first : first + n - window + 1]
                    near = np.minimum(np.searchsorted(marked, mine), len(marked) - 1)
                    keep = keep_mask(n, np.flatnonzero(marked[near] == mine), window)
                n_words.append(n)
                n_removed.append(n - int(keep.sum()))
                kept.append(b" ".join(compress(own, keep.tolist()) if n_removed[-1] else own).decode())
                gone.append(spans(keep) if with_repeats and n_removed[-1] else [])
        made = [run.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(gone, repeat)]
        return pa.RecordBatch.from_arrays(made + [run.column(f"c{i}") for i in range(len(columns))], ["doc_id", "n_words", "n_removed", "kept_text", "repeats", *(f"c{i}" for i in range(len(columns)))])

    repeat = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    types = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = met.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<start:long,length:long>>{types}")
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *["repeats"] * with_repeats, *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13)
), hit AS (
  SELECT g.doc_id, g.i FROM g JOIN (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1) USING (s) WHERE g.doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit
), lost AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
