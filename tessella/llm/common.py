"""Shared plumbing: the folder all executors see, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the word-based operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"


_FOLDER: ContextVar[str | None] = ContextVar("folder of intermediate tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    If that is unset, a local session (tests) gets a temporary folder; on a cluster it is an error, as a folder of one
    machine is not seen by the others.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written under it are deleted at its end; for a result that is written whole somewhere else."""
    folder = new_path(spark, "scratch")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written under it go when it is written, not when the driver next collects its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SWEEP)
        else:
            spark.conf.set(_SWEEP, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = path or new_path(df.sparkSession, name)
    with _swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow table (numbers and digests) that may be broadcast: some ten megabytes.
_SMALL = 100_000
_BYTES = 32 << 20


def if_small(df: DataFrame, most: int = _SMALL) -> DataFrame:
    """Marks a written or checkpointed narrow table for broadcast if it is counted to have at most ``most`` rows.

    A larger one joins by a shuffle, whose crowded partitions Spark splits.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(df: DataFrame, most: int = 512) -> DataFrame:
    """Lowers the session's bounds of an Arrow batch to ``most`` rows and ``_BYTES`` bytes, as a batch of texts is held in
    memory whole. They stay lowered, as the plan reads them when it runs; a single text may be larger."""
    conf = df.sparkSession.conf
    for key, bound in (("maxRecordsPerBatch", most), ("maxBytesPerBatch", _BYTES)):
        now = int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if now <= 0 or now > bound:
            conf.set(f"spark.sql.execution.arrow.{key}", bound)
    return df


def release_memory() -> None:
    """Gives memory that a task has freed back to the machine: Python workers live on after their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_blanks(text: Column) -> Column:
    """``text`` (null: empty) without ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), as a long.

    A word starts at each non-blank character that follows a blank or nothing: all non-blank runs are cut to one
    character first, so the count is a length and no array of words is built.
    """
    return F.length(F.regexp_replace(without_runs(text), r"[\x20\x09-\x0D]+", "")).cast("long")


def without_runs(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


def sample_by_hash(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (all, if fewer) by a hash of ``key``: the same rows on each run, found without sorting."""
    n = rows.count()
    if n <= bound:
        return rows
    steps = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < int(steps * bound / n))
