"""Token counts from flat token files: a vectorised scan for end-of-document ids.

A token file is a run of unsigned little-endian integers, documents one after
another with one end id after each, no index. Files of one stream continue
each other at any point, so a document may lie over several blocks and files.
Each block is searched by itself for end ids; what reaches over its edges is
settled by a prefix scan over one summary row for each block: how many
documents ended before it, and where the last one did.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from munjang.llm import bpe, shared

END_ID = 50256
#: Tokens in a file that the writer makes, and in a block that one task scans at a time.
FILE_TOKENS, BLOCK_TOKENS = 1 << 22, 1 << 19


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, dtype: str = "<u2", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write documents as token files below ``folder`` (any URI that Arrow opens) and return the manifest.

    Manifest rows: (stream, shard, uri, n_tokens) for files and (stream,
    ordinal, doc_id) for documents. A task writes a stream of its own, under
    names that no other attempt uses, so only files of the attempts that
    counted are in the manifest. It must be saved before it is read twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, stream = bpe.codec(vocabulary, False), TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt, shard, ordinal, held, size = uuid.uuid4().hex, 0, 0, [], 0

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, shard
            flat = np.concatenate(held) if held else np.zeros(0, dtype)
            while len(flat) >= file_tokens or everything and len(flat):
                part, flat = flat[:file_tokens], flat[file_tokens:]
                name = f"{root}/tokens-{stream}-{shard}-{attempt}.bin"
                with files.open_output_stream(name) as out:
                    out.write(part.tobytes())
                yield rows(stream=[stream], shard=[shard], uri=[f"{folder}/{name.rsplit('/', 1)[1]}"], n_tokens=[len(part)])
                shard += 1
            held, size = [flat], len(flat)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for value in batch.column("text"):
                got = codec.encode(value.as_py() or "")
                got.append(end_id)
                held.append(np.array(got, dtype))
                size += len(got)
                if size >= file_tokens:
                    yield from flush(False)
            yield rows(stream=[stream] * len(ids), ordinal=range(ordinal, ordinal + len(ids)), doc_id=ids)
            ordinal += len(ids)
        yield from flush(True)

    schema = pa.schema([("stream", pa.int64()), ("shard", pa.int64()), ("uri", pa.string()), ("n_tokens", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
    return shared.texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "stream long, shard long, uri string, n_tokens long, ordinal long, doc_id long")


def scan_block(tokens: np.ndarray, end_id: int) -> np.ndarray:
    """Positions of the end ids of a block."""
    return np.flatnonzero(tokens == end_id)


def count(files: DataFrame, end_id: int = END_ID, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of the documents in ``files`` (stream, shard, uri, n_tokens): one row (stream, ordinal, n_tokens) per document, its end id not counted.

    What follows a stream's last end id is a document if it holds a token. A
    document of the end id alone has 0 tokens; empty files have no documents.
    """
    width = np.dtype(dtype).itemsize
    first = Window.partitionBy("stream").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.where("n_tokens > 0").select("stream", "uri", "n_tokens", F.coalesce(F.sum("n_tokens").over(first), F.lit(0)).alias("before"))
    blocks = placed.select("stream", "uri", "n_tokens", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(block_tokens).cast("long"))).alias("skip"))
    blocks = blocks.select("stream", "uri", "skip", F.least(F.lit(block_tokens).cast("long"), F.col("n_tokens") - F.col("skip")).alias("length"), (F.col("before") + F.col("skip")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(row["uri"])
                with files.open_input_file(path) as f:
                    tokens = np.frombuffer(f.read_at(row["length"] * width, row["skip"] * width), dtype)
                ends = scan_block(tokens, end_id)
                inner = np.diff(ends) - 1
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["stream"]]), pa.array([row["at"]]), pa.array([row["length"]]), pa.array([n], pa.int64()), pa.array([row["at"] + int(ends[0]) if n else None], pa.int64()), pa.array([row["at"] + int(ends[-1]) if n else None], pa.int64()), pa.array([inner], pa.list_(pa.int64()))],
                    ["stream", "at", "length", "n", "first_end", "last_end", "inner"],
                )

    # One write and read, so the shuffle that spreads blocks over tasks is on a few numbers a block, and files are read once.
    found = shared.save(blocks.repartition(shared.partitions(files.sparkSession), "stream", "at").mapInArrow(run, "stream long, at long, length long, n long, first_end long, last_end long, inner array<long>"), "token-blocks")
    scan = Window.partitionBy("stream").orderBy("at")
    prior = scan.rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.drop("inner").withColumns({"ordinal": F.coalesce(F.sum("n").over(prior), F.lit(0)), "carry": F.coalesce(F.max("last_end").over(prior), F.lit(-1)), "final": F.lead("at").over(scan).isNull()})
    over_edges = stitched.where("n > 0").select("stream", "ordinal", (F.col("first_end") - F.col("carry") - 1).alias("n_tokens"))
    open_end = F.col("at") + F.col("length") - 1 - F.greatest("carry", F.coalesce("last_end", F.lit(-1)))
    unended = stitched.where("final").select("stream", (F.col("ordinal") + F.col("n")).alias("ordinal"), open_end.alias("n_tokens")).where("n_tokens > 0")
    within = found.select("stream", "at", F.posexplode("inner").alias("k", "n_tokens")).join(stitched.select("stream", "at", "ordinal"), ["stream", "at"])
    return over_edges.unionByName(unended).unionByName(within.select("stream", (F.col("ordinal") + 1 + F.col("k")).alias("ordinal"), "n_tokens"))


def document_counts(docs: DataFrame, vocabulary: str | None = None, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, through token files in the shared folder.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows
    are counted each; the end id's text inside a document is ordinary text.
    """
    spark = docs.sparkSession
    folder = f"{shared.folder(spark)}/munjang/tokens-{uuid.uuid4().hex}"
    manifest = shared.save(write(docs, folder, vocabulary, file_tokens=file_tokens), "token-manifest")
    counts = count(manifest.where("uri is not null").select("stream", "shard", "uri", "n_tokens"), block_tokens=block_tokens)
    names = manifest.where("uri is null").select("stream", "ordinal", "doc_id")
    return names.join(counts, ["stream", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
