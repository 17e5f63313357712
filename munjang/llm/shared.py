"""Tables written between the steps of a job, and small helpers for Arrow maps.

A step that several later ones read is written as Parquet to the folder that
the cluster names in ``spark.checkpoint.dir``, so a lost executor costs only
the tasks it ran. Nothing is kept in executors' own folders.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder. A local session that names none has one of this process; on a cluster that would be each machine's own, so there it is an error."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
        raise ValueError(f"set {KEY} to a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="munjang-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{folder(spark)}/munjang/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete what jobs wrote to the shared folder more than ``hours`` ago, through Spark's own file systems; the number of tables and files that went. Results are read lazily from these tables, so young ones stay."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/munjang")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    # Now is what the folder's own clock says, which need not be that of this machine.
    mark = spark._jvm.org.apache.hadoop.fs.Path(root, f"now-{uuid.uuid4().hex}")
    files.create(mark).close()
    now = files.getFileStatus(mark).getModificationTime()
    files.delete(mark, False)
    old = [x.getPath() for x in files.listStatus(root) if x.getModificationTime() < now - 3_600_000 * hours]
    return sum(bool(files.delete(x, True)) for x in old)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions an int that ``repartition`` puts there, so that n groups fill n partitions evenly."""
    k = F.col("id").cast("int")
    found = spark.range(24 * n).select(F.pmod(F.hash(k), F.lit(n)).alias("p"), k.alias("k")).groupBy("p").agg(F.min("k").alias("k"))
    keys = {r["p"]: r["k"] for r in found.collect()}
    return [keys.get(p, p) for p in range(n)]


#: Rows of an Arrow batch of texts at most: ten thousand, Spark's default, may be a hundred megabytes on either side.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(docs: DataFrame) -> DataFrame:
    """``docs`` as the Arrow maps take them: in small batches (a setting of the session, as a lazy result is run after this returns), and over all cores where a small input lies in fewer parts (a large one is never moved)."""
    spark = docs.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups of consecutive rows with one key, over batches; rows must be sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        runs = keys.to_numpy(zero_copy_only=False)
        cuts = [0, *((runs[1:] != runs[:-1]).nonzero()[0] + 1).tolist(), len(runs)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and runs[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = runs[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def bitmap(df: DataFrame, column: str, bits: int):
    """A bitmap of 2**bits places, by the top bits of a hash column: of fixed size, whatever the rows. For thinning out work before an exact step."""
    import numpy as np

    top = 4
    width = 1 << (bits - top)
    keyed = df.selectExpr(f"shiftrightunsigned({column}, {64 - bits}) AS slot").selectExpr(f"cast(shiftrightunsigned(slot, {bits - top}) AS int) AS part", "slot").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in by_group(batches, "part"):
            place = np.zeros(width, np.uint8)
            place[table["slot"].to_numpy() - int(part) * width] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([np.packbits(place).tobytes()], pa.binary())], ["part", "blob"])

    sent = keyed.repartition(1 << top, "part").sortWithinPartitions("part").mapInArrow(run, "part int, blob binary")
    out = np.zeros((1 << top, width // 8), np.uint8)
    for row in sent.collect():
        out[row["part"]] = np.frombuffer(row["blob"], np.uint8)
    return out.reshape(-1)
