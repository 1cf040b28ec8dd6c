"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the reliable checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which the cluster names in spark.checkpoint.dir.

    Only where that setting is unset and all runs on this machine (tests) is it a folder of the
    machine's own; executors elsewhere couldn't read what is written there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plenara-checkpoint-"))
    return named.rstrip("/") if named else context._jsc.sc().getCheckpointDir().get()


#: Folders of tables that `written` has made and nobody has released yet.
_tables: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again; unlike a checkpoint it is compressed and read by column.

    `release` deletes it as soon as no result needs it any more; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plenara-{uuid.uuid4().hex}"
    _tables[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.plenara_path = path
    return out


def tables() -> set[str]:
    """The folders of all tables that are there."""
    return set(_tables)


def release(*gone: DataFrame | str) -> None:
    """Delete tables that `written` has made, given as such or by their folders."""
    for table_ in gone:
        path = table_ if isinstance(table_, str) else table_.plenara_path
        spark = _tables.pop(path, None)
        if spark is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nobody holds any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _release_all() -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folders with it
        release(*_tables)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` without the columns that a result of these names would clash with."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with columns that clash with `names` renamed, and a function that gives a table made from it the columns of `df` again.

    For stages that compute columns only to decide by them: nothing of the input is replaced,
    and nothing is carried twice.
    """
    taken = {n.lower() for n in names}
    held = {c: f"__held_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    columns = [F.col(held.get(c, c)).alias(c) for c in df.columns]
    return (df.withColumnsRenamed(held) if held else df), lambda out: out.select(*columns)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on, beside others on the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(df: DataFrame, inputs: list[str], schema: str, make: Callable[[], Callable[..., list]], rows: int = 256, arrow: bool = False, kept: list[str] | None = None) -> DataFrame:
    """`df` plus the columns of `schema`, computed from the columns `inputs` in Arrow batches.

    `make` runs once per task and returns a function from lists of Python values (one list per
    input; Arrow arrays if `arrow`) to lists or Arrow arrays (one per new column). A batch is cut into slices of `rows`
    rows, so that memory stays bounded when texts are long. An existing column with the name of
    a new one is replaced. `kept` names the columns of `df` that come back (all, if none are named).
    """
    added = T.DataType.fromDDL(schema)
    df = without(df, added.fieldNames())
    places = [df.columns.index(c) for c in inputs]
    back = [i for i, c in enumerate(df.columns) if kept is None or c in kept]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*[part.column(i) if arrow else part.column(i).to_pylist() for i in places])
                new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in back), *new], names=[*(part.schema.names[i] for i in back), *target.names])
            batch = part = out = new = None
            give_back()

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in back), *added.fields]))
