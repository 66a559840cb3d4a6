"""Written tables, connected components and helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='meridian-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file, where that package is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bytes of a batch that goes to Python, where the session hasn't set its own bound; a single longer row is its own batch.
BATCH_BYTES, _KEY, _UNSET = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bound what an executor holds of wide rows: batches end by bytes, not only by their number of rows."""
    if spark.conf.get(_KEY) == _UNSET:
        spark.conf.set(_KEY, str(BATCH_BYTES))


#: What this worker keeps from task to task, of one operator at a time.
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):  # noqa: ANN201
    """make(), once for each worker and key; whatever another key has kept goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what another operator keeps in this worker."""
    if _KEPT:
        _KEPT.clear()
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back; what it keeps stays."""

    def with_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return with_trim


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before which the worker drops what another operator keeps, and after which it gives freed memory back, since workers are reused by later stages."""

    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        _release()

    return with_release


def table(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: df written as Parquet into the shared folder, so that a lost executor costs only a new read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.meridian_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.meridian_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, which it does when the driver collects their garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Nodes of a partition's links that are held at once.
NODES = 500_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links, NODES at a time, reduced to (node, smallest node of its local tree)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def trees() -> Iterator[pa.RecordBatch]:
        out = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        for i in range(0, len(out), 100_000):
            part = np.array(out[i : i + 100_000], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > NODES:
            yield from trees()
    yield from trees()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the two long columns of `links`; root is the smallest node reachable.

    Partitions first reduce their own links to trees; then large-star and small-star steps alternate until the trees are stars.
    Every step is an aggregate and a join on the node, so a node with very many links is combined map-side and split by AQE."""
    a, b = links.columns[:2]
    now = table(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(_local_forest, "u long, v long").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and m <> v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, old = table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), now
        drop(old)
        was, before = mark(now), was
        if was == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
