"""Folders that driver and executors share, and their files as Python tasks see them."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster must set; a local session without it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _MADE:
        _MADE.append("file://" + tempfile.mkdtemp(prefix="spark-linewright-core-"))
    return _MADE[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/linewright-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its rows are computed once, whatever reads them later."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_below(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of the file itself, by name; names that begin with ``_`` or ``.`` are left out."""
    system, place = file_system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    every = system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(place) :].strip("/").split("/"))
    return sorted((x.path, x.size) for x in every if x.type == fs.FileType.File and not hidden(x.path) and (not suffixes or x.path.endswith(suffixes)))
