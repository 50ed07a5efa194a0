"""A folder of documents as a data source: listed once, cut into partitions by bytes, read where it is needed.

Filters on the path or the extension act on the listing, so files that they leave out are never opened; Spark applies them again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from redactica.sources import readers

#: Bytes of the files of one partition, and what a file counts for besides its own.
PART_BYTES, FILE_BYTES = 32 << 20, 64 << 10
SCHEMA = f"{readers.READ}, size long"
#: What each filter says of a value that is there.
_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}


class Part(InputPartition):
    """Files (path, extension, bytes) that one task reads."""

    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


def extension(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def cut(files: Iterable[tuple[str, str, int]], part_bytes: int) -> Iterator[list[tuple[str, str, int]]]:
    """Files in order, as many together as have so many bytes; a larger one is alone."""
    held, size = [], 0
    for f in files:
        own = f[2] + FILE_BYTES
        if held and size + own > part_bytes:
            yield held
            held, size = [], 0
        held.append(f)
        size += own
    if held:
        yield held


class DocumentFiles(DataSource):
    """Options: path, a folder as a URI that all machines reach; part_bytes. Rows: path below the folder, ext, text, error_kind, size."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class DocumentReader(DataSourceReader):
    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes, self.filters = folder, part_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = [f for f in filters if type(f) in _TESTS and f.attribute in (("path",), ("ext",))]
        return filters  # to be applied again: here they only choose files

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            path = info.path.removeprefix(root).lstrip("/")
            values = {"path": path, "ext": extension(path)}
            if info.type == fs.FileType.File and all(_TESTS[type(f)](values[f.attribute[0]], f) for f in self.filters):
                found.append((path, values["ext"], info.size))
        return [Part(p) for p in cut(sorted(found), self.part_bytes)] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        for path, ext, size in part.files:
            text, kind = None, None
            if ext not in readers.EXTENSIONS:
                kind = "unsupported"
            else:
                try:
                    with system.open_input_stream(f"{root}/{path}") as f:
                        data = f.read()
                    text = data.decode() if ext == "txt" else readers.EXTRACTORS[ext](data)
                except Exception as e:  # noqa: BLE001  any failure of a parser is a row
                    kind = readers.error_kind(e, ext)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((path, pa.string()), (ext, pa.string()), (text, pa.string()), (kind, pa.string()), (size, pa.int64()))], ["path", "ext", "text", "error_kind", "size"])


def files(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (path, ext, text, error_kind, size) of all files below a folder, whatever their extension."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").option("part_bytes", part_bytes).load(folder)
