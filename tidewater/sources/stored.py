"""Tables and shuffles that a query leaves on the way: written to the folder that all executors see, and deleted in time; rows through Python by Arrow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_LOCAL: list[str] = []
_OPEN: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, as in tests on local[n], a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidewater-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage is cut and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewater/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def made_tables() -> Iterator[list[str]]:
    """The paths of the tables that written() makes meanwhile."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that written() made, when nothing reads them any more."""
    for df in frames:
        removed(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tidewater/" in f})


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, what an action has shuffled is deleted when it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def arrow_mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """run gives the columns of each batch, as lists or arrays. Ids go through as Arrow arrays and keep their 64 bits:
    pandas would make doubles of a long column that holds a null."""
    want = to_arrow_schema(StructType.fromDDL(schema))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, want, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=want)

    return df.mapInArrow(whole, schema)
