"""Written tables in the folder that the driver and all executors share. They go when the application ends."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process (tests), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='meridian-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) for Hadoop's API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, kind: str = "step") -> str:
    """A new path, whatever is written to which is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, computed once: its lineage is cut, so what reads it several times neither repeats its plan nor its work, and a lost executor costs a new read."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: (application, folder, state of its files, name, definition) to (path, schema)
_KEPT: dict[tuple, tuple[str, StructType]] = {}


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files of some paths: another state means other contents."""
    out = []
    for path in paths:
        fs, p = file_system(spark, path)
        out += sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else [None]
    return tuple(out)


def kept(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], buckets: tuple[str, int] | None = None) -> DataFrame:
    """make(), written once in the application for each key, and read by all queries that need it. `buckets` (a column and their number): what joins or groups by that column needs no shuffle of the
    table; make() should have dealt its rows so already. The table's entry in the catalog goes with the application's session catalog, its files when the application ends."""
    key = (spark.sparkContext.applicationId, *key)
    found = _KEPT.get(key)
    if found:
        fs, p = file_system(spark, found[0])
        if not fs.exists(p):
            found = None
    if not found:
        df = make()
        path = new_path(spark)
        if buckets:
            df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets[1], buckets[0]).saveAsTable(_table_of(path))
        else:
            df.write.option("compression", "zstd").parquet(path)
        _KEPT[key] = found = path, df.schema
    return spark.table(_table_of(found[0])) if buckets else spark.read.schema(found[1]).parquet(found[0])


def _table_of(path: str) -> str:
    return "meridian_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
