"""Files under given names, written as one batch: a data source that Spark writes to.

Tasks write what they have to do under names of their own into a staging folder beside the files, and a list of it. When all have
done so, the batch is marked as whole and its files are moved to their names, none of which may be taken. A task that fails, or runs
again, leaves nothing but staged files; a batch that cannot be finished is taken back. If the driver is lost while files are moved,
`recover` finishes what was marked and clears what was not.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_STAGING, _LIST, _WHOLE = "_staging-", "list-", "whole"


@dataclass
class Listed(WriterCommitMessage):
    """The list that a task has left; the files themselves may be very many."""

    path: str | None


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _is_there(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


def _moves(system, lists: list[str]) -> Iterator[tuple[str, str]]:
    for path in lists:
        with system.open_input_stream(path) as f:
            yield from map(json.loads, f.read().decode().splitlines())


class NamedFiles(DataSource):
    """Options: path, the folder as a URI that all machines reach. Rows: name, of a file in one subfolder at most, and content."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("files are added, never overwritten")
        return NamedFilesWriter(self.options["path"])


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        system, root = _system(self.folder)
        stage, moves = f"{root}/{self.staging}", []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not content.is_valid:
                    continue
                if not re.fullmatch(r"(?:[^/\\]+/)?[^/\\]+", name or "") or ".." in name.split("/") or name.startswith(_STAGING):
                    raise ValueError("a name is that of a file, in one subfolder at most")
                if not moves:
                    system.create_dir(stage, recursive=True)
                made = f"{stage}/{uuid.uuid4().hex}"
                with system.open_output_stream(made) as out:
                    out.write(content.as_buffer())
                moves.append((made, f"{root}/{name}"))
        if not moves:
            return Listed(None)
        path = f"{stage}/{_LIST}{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            out.write("".join(json.dumps(m) + "\n" for m in moves).encode())
        return Listed(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.folder)
        lists = [m.path for m in messages if m is not None and m.path]
        if not lists:
            return
        stage = f"{root}/{self.staging}"
        with system.open_output_stream(f"{stage}/{_WHOLE}") as out:
            out.write("\n".join(lists).encode())
        done = []
        try:
            for made, name in _moves(system, lists):
                if _is_there(system, name):
                    raise FileExistsError("a name of the batch is taken")
                system.create_dir(name.rpartition("/")[0], recursive=True)
                system.move(made, name)
                done.append(name)
        except BaseException:
            for name in done:
                system.delete_file(name)
            system.delete_dir(stage)
            raise
        system.delete_dir(stage)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.folder)
        if _is_there(system, f"{root}/{self.staging}"):
            system.delete_dir(f"{root}/{self.staging}")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content: binary), those without content aside, as one batch; rows (name, size)."""
    rows = rows.select("name", "content").filter("content is not null")
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.write.format("named_files").mode("append").save(folder)
    return rows.select("name", F.octet_length("content").cast("long").alias("size"))


def recover(folder: str) -> int:
    """Finishes the batches whose move was cut short, clears the others, and says how many files it moved. No writer may be at work."""
    from pyarrow import fs

    system, root = _system(folder)
    moved = 0
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name.startswith(_STAGING):
            if _is_there(system, whole := f"{info.path}/{_WHOLE}"):
                with system.open_input_stream(whole) as f:
                    lists = f.read().decode().split("\n")
                for made, name in _moves(system, lists):
                    if _is_there(system, made):
                        if _is_there(system, name):
                            raise FileExistsError("a name of the batch is taken")
                        system.create_dir(name.rpartition("/")[0], recursive=True)
                        system.move(made, name)
                        moved += 1
            system.delete_dir(info.path)
    return moved
