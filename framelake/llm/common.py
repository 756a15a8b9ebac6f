"""What the corpus operators share: word patterns, tables, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..lineage import cut, swept

#: White space and words of all contracts, as Java (and Python) patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name as it is: a dot in it is no field of a struct."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(quoted(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def widened(df: DataFrame, **columns: DataType) -> StructType:
    """The schema of `df` and more columns, whatever names and types it has."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in columns.items())])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most so many rows and about so many bytes, so that what a worker makes of one stays small."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        yield from (b.slice(k, step) for k in range(0, b.num_rows, step))


def saved(df: DataFrame) -> DataFrame:
    """Like `cut`, but as a Parquet table in the shared folder, whose size Spark then knows when it chooses a join."""
    spark = df.sparkSession
    cut(spark.range(0))  # makes sure that the folder is set
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gone(tables: list[DataFrame]) -> None:
    """Deletes tables of `saved`, from which all that is needed has been saved, and empties the list."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    tables.clear()


#: Caches (of lru_cache) that workers keep from task to task.
_CACHES: list = []


def kept(cache):
    """Marks a cache that a worker keeps; a decorator."""
    _CACHES.append(cache)
    return cache


def let_go(*mine) -> None:
    """Empties the caches that this worker has kept for other operators than the one whose tasks begin with this, and gives back what
    earlier tasks have freed: the same workers serve one after the other, and their memory need not hold what all of them kept."""
    for c in _CACHES:
        if c not in mine and c.cache_info().currsize:
            c.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
