"""``df.write.format("named_files")``: one file for each row, under the row's own name.

    spark.dataSource.register(NamedFiles)
    df.select("name", "text").write.format("named_files").mode("overwrite").save("/notes")

Rows are (``name``, ``text``) or (``name``, ``content``); names may hold folders.
A task writes into a folder of its attempt below ``_staging``; only when all tasks
are done does the driver move the files of the attempts that won to their names,
so a reader never sees a half file, a repeated attempt leaves nothing behind, and a
job that fails removes its staging and changes nothing (a task that outlives the
failure may leave files there, which readers skip as hidden).  ``overwrite`` replaces
files of the same names and leaves others; ``append`` refuses names that exist,
before it moves any.  Two rows of one name are an error, found before anything is
moved.  A crash while files are moved leaves whole files alone, some new and some
old, and the same job run again completes them.

The driver handles one name for each file and moves them in threads; many millions
of files a job should be written by folder in several jobs.  ``text`` null counts
as empty; a null or empty name, an absolute one, or one that leaves the folder is
an error.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import file_system, new_path

_THREADS = 16


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of a task's attempt and the names it wrote."""

    folder: str
    names: list[str]


def checked_name(name: str | None) -> str:
    """The name in its plainest form, if it stays below the folder."""
    plain = posixpath.normpath(name) if name else ""
    if plain in ("", ".") or plain.startswith(("/", "../", "_", ".")) or plain == "..":
        raise ValueError(f"not a name of a file below the folder: {name!r}")
    return plain


class NamedWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        if columns[:1] != ["name"] or len(columns) != 2 or columns[1] not in ("text", "content"):
            raise ValueError("rows must be (name, text) or (name, content)")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        system, root = file_system(self.path)
        return system, root, f"{root}/_staging/{self.job}"

    def write(self, iterator: Iterator) -> Attempt:
        system, _, staging = self._places()
        task = TaskContext.get()
        folder, names = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}", []
        made: set[str] = set()
        for row in iterator:
            name = checked_name(row[0])
            parent = posixpath.dirname(f"{folder}/{name}")
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            data = row[1] or b""
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(data.encode() if isinstance(data, str) else bytes(data))
            names.append(name)
        return Attempt(folder, names)

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root, staging = self._places()
        moves = [(m.folder, name) for m in messages if m for name in m.names]
        try:
            if len({name for _, name in moves}) < len(moves):
                raise ValueError("two rows have one name")
            if not self.overwrite:
                there = system.get_file_info([f"{root}/{name}" for _, name in moves])
                if taken := [x.path for x in there if x.type != fs.FileType.NotFound]:
                    raise FileExistsError(taken[0])
            for parent in sorted({posixpath.dirname(f"{root}/{name}") for _, name in moves} | {root}):
                system.create_dir(parent, recursive=True)
            with ThreadPoolExecutor(_THREADS) as pool:
                list(pool.map(lambda x: system.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), moves))
        finally:
            self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """This job's staging goes, and the folder of all stagings if no other job uses it."""
        system, root, staging = self._places()
        for place in (staging, f"{root}/_staging"):
            info = system.get_file_info(place)
            if info.type == fs.FileType.Directory and (place == staging or not system.get_file_info(fs.FileSelector(place))):
                system.delete_dir(place)


class NamedFiles(DataSource):
    """A file for each row."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], schema.names, overwrite)


def write_named(df: DataFrame, path: str, name: Column, text: str = "text", mode: str = "overwrite") -> None:
    """Write each row's text, or binary content, to the file ``name`` below ``path``."""
    df.sparkSession.dataSource.register(NamedFiles)
    target = "content" if dict(df.dtypes)[text] == "binary" else "text"
    df.select(name.alias("name"), F.col(text).alias(target)).write.format("named_files").mode(mode).save(path)


def named_in_shared(df: DataFrame, folder: str, name: Column, text: str = "text") -> str:
    """Write the files into a new folder of the shared one; returns its path."""
    path = new_path(df.sparkSession, folder)
    write_named(df, path, name, text)
    return path
