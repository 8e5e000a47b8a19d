"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares for intermediate tables. Where none is named, a local session gets
    a folder of its own; on a cluster that would be another disk on every executor, so there it is an error."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or _own_folder(sc)
    return f"{shared.rstrip('/')}/pageloom-{uuid.uuid4().hex}"


def _own_folder(sc: SparkContext) -> str:
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
    return sc.getCheckpointDir()


class Tables:
    """The intermediate tables that are written while it is entered; a run deletes its own and no others."""

    def __init__(self) -> None:
        self.paths: set[str] = set()

    def __enter__(self) -> Tables:
        self._before = _noted.set((*_noted.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _noted.reset(self._before)

    def forget(self, spark: SparkSession, *kept: DataFrame) -> None:
        """Deletes those that the kept frames do not read."""
        _deleted(spark, self.paths - set().union(*(_read_by(df, self.paths) for df in kept)))


_noted: ContextVar[tuple[Tables, ...]] = ContextVar("noted", default=())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and its size is known."""
    path = scratch(spark := df.sparkSession)
    df.write.parquet(path)
    for tables in _noted.get():
        tables.paths.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _read_by(df: DataFrame, paths: set[str]) -> set[str]:
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return {t for t in paths if t.rpartition("/")[2] in folders}


def _deleted(spark: SparkSession, paths: set[str]) -> None:
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        for tables in _noted.get():
            tables.paths.discard(p)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more; what else the frames read stays."""
    for df in tables:
        if df is not None:
            folders = {f.rpartition("/")[0] for f in df.inputFiles()}
            _deleted(df.sparkSession, {f for f in folders if f.rpartition("/")[2].startswith("pageloom-")})


#: What is broadcast has at most as many bytes; more is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def bytes_of(df: DataFrame) -> int:
    """How much memory the rows take, a little more rather than less."""
    each = F.lit(32)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        wide = F.length(c) if kind in ("string", "binary") else F.size(c) * 8 if re.fullmatch(r"array<(tinyint|smallint|int|bigint|float|double)>", kind) else F.lit(0) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp") else None
        if wide is None:
            raise TypeError(f"{name}: {kind} has no known size")
        each = each + 16 + F.greatest(F.coalesce(wide, F.lit(0)), F.lit(0))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def bounded(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it is small enough; it should be a written table."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df


#: Bits of the filter that large tables of keys are reduced to: 2 ** 20 rows of two numbers at most.
FILTER_BITS = 1 << 26


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    tag = uuid.uuid4().hex
    return [f"_{name}_{tag}" for name in names]


def _screened(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows that may have a key of keys, and those that surely have none. What is broadcast has a fixed size."""
    at, word, bits = fresh("place", "word", "bits")
    place = lambda: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    held = keys.select(place().alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))")).alias(bits))
    found = rows.withColumn(at, place()).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(written(held)), word, "left")
    hit = F.expr(f"coalesce(shiftrightunsigned({bits}, CAST({at} & 63 AS INT)) & 1, 0) = 1")
    return found.filter(hit).select(*rows.columns), found.filter(~hit).select(*rows.columns)


def with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows joined with the rows of keys (a written table). Long rows stay where they are if keys can be broadcast;
    otherwise only those travel that pass a filter of fixed size."""
    if bytes_of(keys) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), key)
    return _screened(rows, keys, key)[0].join(keys, key)


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in keys (a written table); those with a null key stay. Rows travel as in with_keys."""
    if bytes_of(keys) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), key, "left_anti").select(*rows.columns)
    maybe, rest = _screened(rows, keys, key)
    return rest.unionByName(maybe.join(keys, key, "left_anti").select(*rows.columns))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a Python worker, which Spark uses again, gives the memory that is free back to the system."""

    def outer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)

    return outer


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text; a null doc_id counts as the empty string."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def lower_ascii(column: str | Column) -> Column:
    return F.translate(column, UPPER, LOWER)
