"""Spark data sources of the exchange formats: ``spark.read.format("tmx").load(path)`` and ``df.write.format("tmx")``.

Readers take a file, folder or pattern on a file system that the executors share and make one task a file; writers
write one file a task.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bitextra.sources import formats

SCHEMA = "source string, target string, context string, created timestamp_ntz, modified timestamp_ntz, created_by string, modified_by string, refcount int"
_ARROW = pa.schema([("source", pa.string()), ("target", pa.string()), ("context", pa.string()), ("created", pa.timestamp("us")), ("modified", pa.timestamp("us")), ("created_by", pa.string()), ("modified_by", pa.string()), ("refcount", pa.int32())])
_BATCH = 8192


def _local_path(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, dict(options)

    def partitions(self) -> list[_File]:
        path = _local_path(self.options["path"])
        found = sorted(glob.glob(f"{path}/*.{self.kind}*")) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_File(p) for p in found if os.path.getsize(p)] or []

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        o = self.options
        with open(partition.path, "rb") as f:
            if self.kind == "tmx":
                rows = formats.read_tmx(f, o.get("sourcelang"), o.get("targetlang"), o.get("flavour", "js"))
            elif self.kind == "xliff":
                rows = formats.read_xliff(f)
            else:
                rows = formats.read_xlsx(f, int(o.get("sourcecol", 1)), int(o.get("targetcol", 2)), o.get("sheet"), int(o.get("headerrow", 1)))
            held: list[dict] = []
            for r in rows:
                held.append({"context": "", "created_by": "", "modified_by": "", "refcount": 0} | r)
                if len(held) == _BATCH:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, _ARROW)


class _Writer(DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        self.kind, self.options, self.folder = kind, dict(options), _local_path(options["path"])
        if overwrite and os.path.isdir(self.folder):
            for p in glob.glob(f"{self.folder}/part-*.{kind}"):
                os.remove(p)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        o = self.options
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/part-{uuid.uuid4().hex}.{self.kind}"
        rows = (r for b in batches for r in b.to_pylist())
        with open(f"{path}.tmp", "wb") as f:
            if self.kind == "tmx":
                formats.write_tmx(f, rows, o.get("sourcelang", "en"), o.get("targetlang", "ja"), o.get("flavour", "js"))
            elif self.kind == "xliff":
                formats.write_xliff(f, rows, o.get("sourcelang", "en"), o.get("targetlang", "ja"), o.get("version", "1.2"))
            else:
                formats.write_xlsx(f, rows, o.get("sourcelang", "Source"), o.get("targetlang", "Target"))
        return _Written(path)

    def commit(self, messages: list) -> None:
        """Files get their names only once all tasks are done."""
        kept = {m.path for m in messages if m is not None}
        for p in glob.glob(f"{self.folder}/part-*.tmp"):
            if p[:-4] in kept:
                os.replace(p, p[:-4])

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{m.path}.tmp"):
                os.remove(f"{m.path}.tmp")


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.kind, self.options, overwrite)


class TmxSource(_Source):
    kind = "tmx"


class XliffSource(_Source):
    kind = "xliff"


class XlsxSource(_Source):
    kind = "xlsx"


def register(spark: SparkSession) -> None:
    for s in (TmxSource, XliffSource, XlsxSource):
        spark.dataSource.register(s)


#: fixed values: file suffixes and the formats they stand for
SUFFIXES = {"tmx": "tmx", "xml": "tmx", "tsv": "tsv", "txt": "tsv", "csv": "tsv", "xlsx": "xlsx", "xls": "xlsx", "xliff": "xliff", "xlf": "xliff", "sdlxliff": "xliff"}


def format_of(path: str, fmt: str | None = None) -> str:
    key = (fmt or path.rpartition(".")[2]).lower()
    if key not in SUFFIXES:
        raise ValueError(f"unknown format: {key}")
    return SUFFIXES[key]


def read_memory(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """Records of a file or folder, by its suffix or ``fmt``."""
    kind = format_of(path, fmt)
    if kind == "tsv":
        from bitextra.sources.tsv import read_tsv

        return read_tsv(spark, path, **{k: v for k, v in options.items() if k in ("source_col", "target_col", "header", "both")})
    register(spark)
    return spark.read.format(kind).options(**options).load(path)


def write_memory(df: DataFrame, path: str, fmt: str | None = None, **options: str) -> None:
    """Write records to a folder, one file a task."""
    kind = format_of(path, fmt)
    if kind == "tsv":
        from bitextra.sources.tsv import write_tsv

        return write_tsv(df, path)
    register(df.sparkSession)
    cols = {"source": "string", "target": "string", "context": "string", "created": "timestamp_ntz", "modified": "timestamp_ntz", "created_by": "string", "modified_by": "string", "refcount": "int", "reliability": "int", "validated": "boolean"}
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])
    out.write.format(kind).options(**options).mode("overwrite").save(path)
