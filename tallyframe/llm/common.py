"""Shared helpers: scratch tables in the cluster's shared folder, and Arrow text buffers as numpy arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master may leave it unset: then one folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyframe"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back, which cuts its lineage. `release` deletes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise_freeing(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """As materialise, and the shuffle files that only this write has used go when it ends, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return materialise(df, label, compression)
    finally:
        conf.set(FREE_SHUFFLES, before) if before is not None else conf.unset(FREE_SHUFFLES)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more. What a result still reads stays in the shared folder."""
    for df in tables:
        if df is not None and hasattr(df, "scratch_path"):
            delete(df.sparkSession, df.scratch_path)


def quoted(name: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """`row`, a struct of all columns of df, beside keys of an operator's own: no name of df can clash with them."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *[c.alias(name) for name, c in keys.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def id_crc(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets into them; nulls are empty. No copy unless there are nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type in (pa.string(), pa.binary()):
        wide = np.int32
    else:
        array, wide = array.cast(pa.large_string()), np.int64
    if array.null_count:
        array = pc.fill_null(array, b"" if array.type == pa.binary() else "")
    _, offs, data = array.buffers()
    offsets = np.zeros(1, np.int64) if offs is None else np.frombuffer(offs, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    start, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) > 1 else (0, 0)
    raw = np.frombuffer(data, np.uint8)[start:end] if data is not None and end > start else np.zeros(0, np.uint8)
    return raw, offsets - start


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most `limit` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the murmur3 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RangeHash:
    """64-bit hashes of many substrings of one byte array: a polynomial prefix hash modulo 2**64, then a finaliser.

    `base` is odd, so its powers have inverses and every substring's hash comes from two prefix values.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            self.power, self.inverse = (self._powers(x, n) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        steps = np.full(n + 1, x, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of bytes that are not white space; runs end at document ends."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[raw]
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | head[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | head[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
