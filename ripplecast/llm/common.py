"""Shared pieces: shared-folder scratch tables, text kernels, running totals over hot groups."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_kept: dict[str, SparkSession] = {}
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="ripplecast-"))
    return _own_dir[0]


def scratch(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Remove scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path in _kept:
            _delete(path, _kept.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_kept.items()):
        try:
            _delete(path, spark)
        except Exception:  # the JVM may be gone at exit
            return


def shielded(*needed: str):
    """For operators that hand on the columns of docs: those not needed go through under names of their own.

    So no column of docs meets a helper column of the operator.  A column whose name the operator
    itself returns (letter case aside) gives way to the operator's; the others come back unchanged.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            aside = {f"x{n}__aside": c for n, c in enumerate(docs.columns) if c not in needed}
            names = {c: a for a, c in aside.items()}
            out = f(docs.toDF(*[names.get(c, c) for c in docs.columns]), *args, **kwargs)
            own = {c.lower() for c in out.columns if c not in aside}
            out = out.drop(*[a for a, c in aside.items() if c.lower() in own])
            return out.toDF(*[aside.get(c, c) for c in out.columns])

        return run

    return wrap


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words: A-Z lowered, cut at ASCII white space."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(trimmed)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).copy()
    words = lists.flatten()
    none = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if none.any():
        words = words.filter(pc.not_equal(words, ""))
        sizes[none] = 0
    return sizes, words


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most about most_bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * min(1.0, most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def crc_residue(ids: list, modulus: int) -> list[int]:
    """crc32 of each id as text, modulo modulus; a null id counts as the empty text."""
    return [zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids]


def crc_mod(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)


def bucket_count(rows: int, rows_each: int = 100_000, least: int = 64) -> int:
    """A power of two of hash buckets so that a group of all rows has about rows_each in a bucket."""
    n = least
    while n * rows_each < rows:
        n *= 2
    return n


def running_before(df: DataFrame, by: list[str], order: list[str], size: str, buckets: int, out: str) -> DataFrame:
    """Adds out: the sum of size over the rows of the same group that come earlier.

    order[0] is a long with even high bits (a hash, not negative, below 2**62).  A group is dealt to
    buckets of that hash, so a group of any size is summed by many tasks: bucket totals are
    aggregated first, their running sums (at most `buckets` rows a group) shift the sums within.
    """
    cell = f"{out}_cell"
    df = df.withColumn(cell, F.floor(F.col(order[0]) / F.lit((1 << 62) // buckets)).cast("int"))
    inside = Window.partitionBy(*by, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    shift = f"{out}_shift"
    totals = df.groupBy(*by, cell).agg(F.sum(size).alias(shift))
    totals = totals.withColumn(shift, F.coalesce(F.sum(shift).over(across), F.lit(0)))
    key = [*by, cell]
    renamed = totals.select(*[F.col(k).alias(f"{k}__r") for k in key], shift)
    met = df.join(renamed, [df[k].eqNullSafe(renamed[f"{k}__r"]) for k in key])
    return met.withColumn(out, F.col(shift) + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop(cell, shift, *[f"{k}__r" for k in key])


HOT_ROWS, HOT_KEYS = 2048, 1 << 20


def join_hot(rows: DataFrame, found: DataFrame, key: str, times: str, how: str = "inner", limit: int = HOT_ROWS) -> DataFrame:
    """rows joined by key with found, which has a row a key at most and in times how many rows have it.

    Keys of over limit rows are broadcast, so no task gets all rows of one; they are fewer than the rows
    divided by limit, and their number is checked.  The others are shuffled.  rows is read twice.
    """
    hot = found.where(F.col(times) > limit)
    n = hot.limit(HOT_KEYS + 1).count()
    if not 0 < n <= HOT_KEYS:
        return rows.join(found, key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col(times) <= limit), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def hash62(*columns: Column) -> Column:
    """A hash in [0, 2**62) with even high bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)
