"""What the operators share: the folder that all executors see, staged tables, Arrow batches and base expressions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handed to a Python worker at once; long texts make batches of fewer rows.
BATCH_ROWS = 512

#: Bytes of sources for each file that few_files() allows.
FILE_BYTES = 4 << 20

#: By application, the folders made in the shared folder.
_MADE: dict[str, list[str]] = {}

#: In a Python worker: what operators keep from task to task, by operator, and the operator that ran last.
KEPT: dict[str, dict] = {}
_LAST = [""]

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which the cluster names and every executor sees.

    A path without a scheme is the default file system's. Where that setting is absent a temporary folder takes its place on
    one machine (a local master), and on a cluster, whose executors wouldn't see it, there is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them see")
        base = getattr(spark, "_porelake_shared", None)
        if not base:
            base = spark._porelake_shared = "file://" + tempfile.mkdtemp(prefix="porelake-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/porelake-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    made = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def remove_made(spark: SparkSession) -> None:
    """Deletes all that this library has put into the shared folder for this application; results read before must not be used again."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and, where this Spark knows it, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception:  # noqa: BLE001  a Spark without that setting
        pass


def let_go(owner: str) -> None:
    """Empties what other operators than owner keep in this worker and gives the memory that is free back to the system.

    Workers outlive a stage, so tables of one would stay beside those of the next, and once more in each idle worker.
    """
    for name, tables in KEPT.items():
        if name != owner:
            tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def owned(owner: str, rows: Rows) -> Rows:
    """rows, for mapInArrow, as tasks of an operator: the first one in a worker after another operator's lets go of that one's tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LAST[0] != owner:
            let_go(owner)
            _LAST[0] = owner
        yield from rows(batches)

    return run


def few_files(df: DataFrame) -> DataFrame:
    """df in no more partitions than its sources fill files of FILE_BYTES, and eight for each core at least.

    Small tables in very many partitions would be as many tiny files, each with its own calls to the file system.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(max(8 * df.sparkSession.sparkContext.defaultParallelism, min(size // FILE_BYTES, (1 << 31) - 1)))


def staged(df: DataFrame, by_task: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: cuts lineage, survives lost executors.

    by_task: df's rows carry their partition's number, so its partitions must not be put together.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if by_task else few_files(df)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._porelake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that staged() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        _MADE[spark.sparkContext.applicationId].remove(df._porelake_path)
        remove(spark, df._porelake_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library made in the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Cuts a partition that is sorted by integer key columns into its runs of equal keys, as numpy columns."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        n = len(next(iter(cols.values())))
        change = np.zeros(n - 1, bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {k: v[a:b] for k, v in cols.items()}
        held = {k: v[cuts[-1] :] for k, v in cols.items()}
    if held is not None:
        yield held


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes; a single larger batch stays whole."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"
