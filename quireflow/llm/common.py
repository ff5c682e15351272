"""What the operators of this subpackage share: lineage cuts, row keys, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of an Arrow batch, and the session's setting for them.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quireflow-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables that cut() wrote within own_tables(), innermost last.
_OWN: list[list[DataFrame]] = []


@contextmanager
def own_tables() -> Iterator[None]:
    """Removes the tables that cut() writes meanwhile when it ends: what was to be read from them must be written."""
    _OWN.append([])
    try:
        yield
    finally:
        for table in _OWN.pop():
            drop_table(table)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: later steps neither repeat its work nor lose it with
    an executor. Columnar files take a fraction of what checkpoint() would."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quireflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = table, path
    if _OWN:
        _OWN[-1].append(table)
    return table


#: Tables of cut() and their paths, until they are dropped.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table that cut() wrote, once nothing reads it any more; again does nothing."""
    spark = df.sparkSession
    _, path = _PATHS.pop(id(df), (None, None))
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Removes shuffles that no plan needs any more, as after a cut(): Spark does so when the driver's garbage is collected,
    which may be long after, while the files of each step add up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Hands memory that a Python worker no longer uses back to the system: workers outlive their tasks, and what one
    operator needed at its peak would otherwise add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What a Python worker keeps from one task to the next: the state of one operator, by its name and parameters.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The worker's state of that key, made if it isn't there. Any other state goes first: a worker outlives its tasks
    and serves all operators, so it would otherwise gather the state of each."""
    if key not in _HELD:
        drop_held()
        _HELD[key] = make()
    return _HELD[key]


def drop_held(but: str | None = None) -> None:
    """Lets go of all state but that of the operator named."""
    gone = [k for k in _HELD if k[0] != but]
    for k in gone:
        del _HELD[k]
    if gone:
        gc.collect()
        release()


def in_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str | None = None
) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, whatever the length of texts. A task starts without the state that
    other operators left in its worker (keeps: the operator whose state it uses) and ends with release(). The bound is
    a setting of the session, made unless it has one."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None or int(re.sub(r"\D", "", spark.conf.get(BATCH_SETTING)) or 0) <= 0:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(keeps)
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over the record batches of df; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return in_batches(df, run, schema)


def utf8_of(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string or binary column as UTF-8 bytes, without decoding them."""
    return (v.as_py() for v in column.cast(pa.binary()))


def runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs [start, stop) of a string or binary column that hold about `most` bytes each; a longer value is alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(size) > start:
        yield start, len(size)


def words_of(text: str) -> Column:
    """How many words a text column holds; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
