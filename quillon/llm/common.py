"""What the operators of this subpackage share: the shared folder, stored tables and packed shuffles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are worked through in slices of about this many bytes of text, so that no batch needs much memory.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local session gets
    one of its own; on a cluster that is an error, since a machine's own folder is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        where = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # what is stored needs the shuffle files it came from no longer
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more: what was made of it must be stored itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A list of rows to leave out is broadcast up to so many ids of 8 bytes; a longer one is joined by a shuffle.
BROADCAST_ROWS = 250_000


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in gone (key). Rows with a null key stay."""
    gone = stored(gone.select(key).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*df.columns)


#: No shuffle is cut into more partitions than this for its input's size.
MOST_PARTS = 200_000


def parts(df: DataFrame, per: int | None = None) -> int:
    """Partitions for a packed shuffle: as many as shuffles of this session have, or one for each `per` bytes of df
    as far as its sources tell their size, if that is more."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if per is None:
        return least
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(size // per, MOST_PARTS)) if size < 1 << 60 else least  # beyond: a size nobody knows


def tidy(work):
    """The same work for mapInArrow, but at its end a worker gives memory back that it holds for later: workers live
    on between tasks, and what each of a machine's workers once needed would add up."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C libraries only glibc has it
        if trim:
            trim(0)

    return run


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; a null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def packed(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each value of part, with the bytes of the columns' entries that belong to it.

    A shuffle of such rows moves arrays, not a row for each entry.
    """
    order = np.argsort(part, kind="stable")
    part = part[order]
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[bounds[1:], len(part)] if len(part) else bounds
    arrays = [pa.array(part[bounds].astype(np.int32))]
    for c in columns.values():
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(bounds, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *columns])


def packed_schema(*columns: str) -> str:
    return ", ".join(["part int", *(f"{c} binary" for c in columns)])


def unpacked(batches: Iterator[pa.RecordBatch], **kinds: str) -> dict[str, np.ndarray]:
    """All entries of a partition of packed rows."""
    got: dict[str, list[bytes]] = {c: [] for c in kinds}
    for b in batches:
        for c in kinds:
            got[c] += b.column(c).to_pylist()
    return {c: np.frombuffer(b"".join(got[c]), kinds[c]) for c in kinds}


def squeezed(batch: pa.RecordBatch, **kinds: str) -> pa.RecordBatch:
    """The packed columns named in kinds as differences, byte planes apart, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    for c, kind in kinds.items():
        own = []
        for raw in batch.column(c).to_pylist():
            x = np.frombuffer(raw, kind).view(f"u{np.dtype(kind).itemsize}")
            step = np.concatenate([x[:1], x[1:] - x[:-1]])
            own.append(z.compress(np.ascontiguousarray(step.view(np.uint8).reshape(len(x), -1).T)))
        batch = batch.set_column(batch.schema.names.index(c), c, pa.array(own, pa.binary()))
    return batch


def unsqueezed(batch: pa.RecordBatch, **kinds: str) -> pa.RecordBatch:
    z = zstandard.ZstdDecompressor()
    for c, kind in kinds.items():
        own, wide = [], np.dtype(kind).itemsize
        for raw in batch.column(c).to_pylist():
            planes = np.frombuffer(z.decompress(raw), np.uint8).reshape(wide, -1)
            step = np.empty(planes.shape[::-1], np.uint8)
            for i, x in enumerate(planes):
                step[:, i] = x
            step = step.view(f"u{wide}").ravel()
            own.append(np.cumsum(step, dtype=step.dtype).tobytes())
        batch = batch.set_column(batch.schema.names.index(c), c, pa.array(own, pa.binary()))
    return batch


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64), one to one."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x
