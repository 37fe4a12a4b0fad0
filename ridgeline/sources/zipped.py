"""Zipped CSV files as a data source: each file within a zip is a partition of its own, read as a stream.

    register(spark)
    spark.read.format("zipped_csv").schema("id long, price double").option("names", "id,price,quantity").load("/data/*.zip")

Options: path (a file, a folder or a pattern in the last part; any store that pyarrow reaches, by its address), header (false), names (the columns of
the files, where the schema takes some of them only; default: the schema's), months (2024-01,2024-02: only zips whose name has one of them).
A task holds one block of a file, however long the file is; columns that the schema leaves out are not parsed into it.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a block of a file.
BLOCK_BYTES = 4 << 20


def _opened(path: str):
    """pyarrow's file system of an address, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Member(InputPartition):
    """One file of one zip."""

    path: str
    name: str


class ZippedCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def _zips(self) -> list[str]:
        from pyarrow import fs

        path = self.options["path"]
        store, own = _opened(path)
        prefix = path[: len(path) - len(own)]
        folder, last = posixpath.split(own)
        if any(c in last for c in "*?["):
            found = [i.path for i in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(posixpath.basename(i.path), last)]
        elif store.get_file_info(own).type == fs.FileType.Directory:
            found = [i.path for i in store.get_file_info(fs.FileSelector(own)) if i.path.endswith(".zip")]
        else:
            found = [own]
        months = [m.strip() for m in self.options.get("months", "").split(",") if m.strip()]
        return [prefix + p for p in sorted(found) if not months or any(m in posixpath.basename(p) for m in months)]

    def partitions(self) -> list[Member]:
        out = []
        for path in self._zips():
            store, own = _opened(path)
            with store.open_input_file(own) as f, zipfile.ZipFile(f) as z:  # reads the directory at the zip's end only
                out += [Member(path, n) for n in z.namelist() if n.lower().endswith(".csv")]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        names = [n.strip() for n in self.options["names"].split(",")] if self.options.get("names") else wanted.names
        header = self.options.get("header", "false").lower() == "true"
        store, own = _opened(partition.path)
        with store.open_input_file(own) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            reading = csv.ReadOptions(column_names=names, skip_rows=1 if header else 0, block_size=BLOCK_BYTES)
            kinds = csv.ConvertOptions(include_columns=wanted.names, column_types={c.name: c.type for c in wanted}, strings_can_be_null=True, true_values=["true", "True", "1"], false_values=["false", "False", "0"])
            for batch in csv.open_csv(pa.PythonFile(member, mode="r"), reading, convert_options=kinds):
                yield batch


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        raise ValueError("zipped_csv needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedCsvReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedCsv)
