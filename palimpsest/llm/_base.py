"""What the operators share: the shared folder, lineage cuts, and row handling."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only where it
    is unset and the master is local (tests) is a folder of this machine made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later plans start from the
    files, which outlive any executor. The files go when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs meanwhile sends whole texts to Python workers at most so many rows at a time: the batches
    of both sides are held beside all else. Results don't depend on it; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; whoever owns the folder clears it
            pass


atexit.register(_sweep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def release() -> None:
    """Gives free memory of this process back to the system: Python workers are kept for later stages,
    and what the allocators would keep for them adds to what the executor's other tasks need."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Tables of words that outlive a task, for the next task of its stage.
_tables: list[dict] = []


def lasting(table: dict) -> dict:
    _tables.append(table)
    return table


def forget() -> None:
    for t in _tables:
        t.clear()


def frugal(f, cycles: bool = True):
    """A function for mapInArrow that leaves its worker small. cycles: whether it makes objects that only
    the collector of cycles can free; if not, large tables of words are not searched for them. A function
    of the first kind uses no such table: those that an earlier stage left in its worker go."""

    def run(batches):
        import gc

        if cycles:
            forget()
        else:
            gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()
            release()

    return run


def as_text(value) -> str:
    """A text of an Arrow array, null as empty. Spark and Parquet carry bytes that are not UTF-8 through
    unchecked; they are read as U+FFFD."""
    try:
        return value.as_py() or ""
    except UnicodeDecodeError:
        return value.as_buffer().to_pybytes().decode(errors="replace")


def sliced(batches, rows: int = 1000):
    """The batches in slices, so that what is made of one and waits to be sent stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def one_thread() -> None:
    """Keeps native libraries in Python workers to the core that Spark gave the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
