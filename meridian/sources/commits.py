"""Text tables that appear whole or not at all: a Spark data sink with a commit protocol, and fingerprints that tell what was written without a shuffle.

Tasks write their files into a folder of the run, which nothing reads; each hands back a message (file, rows, bytes, whether a cell holds a line feed, for only then files can't be split when they are read). When all tasks are done the driver lists these
files in a pending manifest and deletes what other attempts have left; if the job fails, the run's folder goes. `publish` then makes any number of tables visible at once by moving
one manifest into place, and only after that deletes what the earlier manifest named. A reader follows the manifest, so it never sees half a table, a
file of a failed attempt or a stale result.

A table's fingerprint is its number of rows and, for each column and for whole rows, the exact sums of two 60-bit hashes of the cells: equal for equal bags in any
order and partitioning, one aggregate without a shuffle of rows. It is observed while the table is written and compared with what reads back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.relational import RuleBroken
from .files import InputError, csv_reader
from .sinks import as_text

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    size: int
    lines: bool


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, columns: list[str]) -> None:
        self.path, self.run, self.columns = path.rstrip("/"), run, columns

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.csv"
        system, root = self._system()
        system.create_dir(f"{root}/{self.run}", recursive=True)
        rows, lines, schema = 0, False, pa.schema([(c, pa.string()) for c in self.columns])
        with system.open_output_stream(f"{root}/{self.run}/{name}") as out, csv.CSVWriter(out, schema, write_options=csv.WriteOptions(include_header=True, quoting_style="needed")) as to:
            for b in iterator:
                rows += len(b)
                lines = lines or any(pc.any(pc.match_substring_regex(c, "[\r\n]")).as_py() for c in b.columns)
                to.write_batch(b.cast(schema))
        return Written(name, rows, system.get_file_info(f"{root}/{self.run}/{name}").size, lines)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._system()
        done = [m for m in messages if m]
        files = [{"file": f"{self.run}/{m.file}", "rows": m.rows, "size": m.size} for m in sorted(done, key=lambda m: m.file)]
        kept = {m.file for m in done}
        for i in system.get_file_info(fs.FileSelector(f"{root}/{self.run}", allow_not_found=True)):
            if i.base_name not in kept:
                system.delete_file(i.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/pending-{self.run}.json") as out:
            out.write(json.dumps({"columns": self.columns, "files": files, "lines": any(m.lines for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        _delete(*self._system(), self.run)


def _delete(system: fs.FileSystem, root: str, run: str) -> None:
    if system.get_file_info(f"{root}/{run}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{run}")
    if system.get_file_info(f"{root}/pending-{run}.json").is_file:
        system.delete_file(f"{root}/pending-{run}.json")


class CommittedTable(DataSource):
    """Options: path (the table's folder), run (a new name for each write)."""

    @classmethod
    def name(cls) -> str:
        return "committed_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if any(f.dataType != StringType() for f in schema):
            raise InputError("the cells of a text table are texts")
        return CommittedWriter(self.options["path"], self.options["run"], schema.names)


def _cell(c: str) -> Column:
    """A cell's text with its length, so that cells don't run into each other; a null isn't an empty text."""
    x = F.col(f"`{c}`").cast("string")
    return F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def _hashes(text: Column) -> list[Column]:
    return [F.conv(F.substring(F.md5(text.cast("binary")), at, 15), 16, 10).cast("decimal(28,0)") for at in (1, 16)]


def _sums(columns: list[str]) -> list[Column]:
    texts = [_cell(c) for c in columns] + [F.concat(*map(_cell, columns))]
    return [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"s{i}_{k}") for i, t in enumerate(texts) for k, h in enumerate(_hashes(t)))]


def fingerprint(df: DataFrame) -> DataFrame:
    """(column_name, n, sum_a, sum_b) of each column, and of whole rows as `(row)`; the sums are whole numbers as text."""
    cells = ", ".join(f"'{c}', n, s{i}_0, s{i}_1" for i, c in enumerate([*df.columns, "(row)"]))
    return df.agg(*_sums(df.columns)).select(F.expr(f"stack({len(df.columns) + 1}, {cells}) AS (column_name, n, sum_a, sum_b)"))


def write_pending(df: DataFrame, path: str, null: str = "") -> str:
    """Write a table that isn't visible yet, hold what reads back against what went in, and return the run's name. RuleBroken, and nothing left, if they differ."""
    spark, text, run = df.sparkSession, as_text(df, null), f"run-{uuid.uuid4().hex}"
    spark.dataSource.register(CommittedTable)
    seen = Observation()
    text.observe(seen, *_sums(text.columns)).write.format("committed_text").option("path", path).option("run", run).mode("append").save()
    back = _table(spark, path, _json(path, f"pending-{run}.json")).agg(*_sums(text.columns)).first().asDict()
    if back != seen.get:
        _delete(*fs.FileSystem.from_uri(path.rstrip("/")), run)
        raise RuleBroken(f"{path} doesn't read back as it was written")
    return run


def _json(folder: str, name: str) -> dict:
    system, root = fs.FileSystem.from_uri(folder.rstrip("/"))
    if not system.get_file_info(f"{root}/{name}").is_file:
        raise InputError(f"nothing has been published in {folder}")
    with system.open_input_stream(f"{root}/{name}") as f:
        return json.loads(f.read())


def _table(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in manifest["columns"]])
    system, root = fs.FileSystem.from_uri(path.rstrip("/"))
    for f in manifest["files"]:
        if system.get_file_info(f"{root}/{f['file']}").size != f["size"]:
            raise InputError(f"{path}/{f['file']} isn't as it was committed")
    files = [f"{path.rstrip('/')}/{f['file']}" for f in manifest["files"] if f["rows"]]
    rows = csv_reader(spark, manifest["lines"]).schema(schema).csv(files) if files else spark.createDataFrame([], schema)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in schema.names))


def publish(results: dict[str, DataFrame], folder: str, checks: DataFrame | None = None, null: str = "") -> None:
    """Write every result or none. First the checks (rows with n_failed) are judged, then each table is written and read back, and at last one manifest is moved into place.

    Whatever fails before that leaves the folder as it was. What the earlier manifest named is deleted afterwards."""
    if checks is not None:
        broken = checks.where("n_failed > 0").limit(20).collect()
        if broken:
            raise RuleBroken(f"nothing is written: {[tuple(r) for r in broken]}")
    folder = folder.rstrip("/")
    system, root = fs.FileSystem.from_uri(folder)
    runs: dict[str, str] = {}
    try:
        for name, df in results.items():
            runs[name] = write_pending(df, f"{folder}/{name}", null)
        new = {name: _json(f"{folder}/{name}", f"pending-{run}.json") for name, run in runs.items()}
        before = _json(folder, MANIFEST) if system.get_file_info(f"{root}/{MANIFEST}").is_file else {}
        temporary = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            out.write(json.dumps(new).encode())
        system.move(temporary, f"{root}/{MANIFEST}")
    except Exception:
        for name, run in runs.items():
            _delete(system, f"{root}/{name}", run)
        raise
    for name, run in runs.items():
        system.delete_file(f"{root}/{name}/pending-{run}.json")
    for name, table in before.items():
        for run in {f["file"].split("/")[0] for f in table["files"]}:
            _delete(system, f"{root}/{name}", run)


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A published table as text cells. InputError if there is none, or if a file isn't as it was committed."""
    manifest = _json(folder, MANIFEST)
    if name not in manifest:
        raise InputError(f"{folder} has no table {name}")
    return _table(spark, f"{folder.rstrip('/')}/{name}", manifest[name])
