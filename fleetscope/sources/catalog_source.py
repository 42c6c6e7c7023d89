"""SRC8 on mounted file systems: a Python data source that lists folders in parallel.

``spark.read.format("file_catalog").load("/backups/*")`` gives host, path, name,
size_bytes, mtime and is_link.  Every folder is a partition of its own, listed by
the task that reads it; file contents are never opened, and link flags come from
the file system, whatever a link is called.  Conditions on ``name`` (equal,
starts with, ends with) and on ``is_link`` are taken over by the listing.

The folders must be mounted on all executors.  Object stores have no links;
their catalog comes from ``files.read_file_catalog``.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import glob
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "host string, path string, name string, size_bytes bigint, mtime timestamp_ntz, is_link boolean"


@dataclass
class Folder(InputPartition):
    path: str


def _folders(root: str) -> list[str]:
    """Folders that fit ``root`` (a path or a glob) and all below them; links to folders are not followed."""
    out, todo = [], [p for p in sorted(glob.glob(root)) if os.path.isdir(p)]
    while todo:
        here = todo.pop()
        out.append(here)
        with os.scandir(here) as entries:
            todo += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
    return sorted(out)


class CatalogReader(DataSourceReader):
    def __init__(self, root: str, fits: str):
        self.root, self.fits = root, fits
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "is", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in kinds and (column == ("name",) or (column == ("is_link",) and isinstance(f, EqualTo))):
                self.tests.append((column[0], kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Folder(p) for p in _folders(self.root)]

    def _wanted(self, name: str, is_link: bool) -> bool:
        for column, kind, value in self.tests:
            have = name if column == "name" else is_link
            if not (have == value if kind == "is" else have.startswith(value) if kind == "starts" else have.endswith(value)):
                return False
        return fnmatch.fnmatchcase(name, self.fits)

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # no folder fits
            return
        host = os.path.basename(partition.path)
        with os.scandir(partition.path) as entries:
            for e in entries:
                link = e.is_symlink()
                if (not link and e.is_dir()) or not self._wanted(e.name, link):
                    continue
                stat = e.stat(follow_symlinks=False)
                when = dt.datetime.fromtimestamp(stat.st_mtime, dt.timezone.utc).replace(tzinfo=None)
                yield host, e.path, e.name, stat.st_size, when, link


class FileCatalog(DataSource):
    """Format ``file_catalog``; option ``glob`` limits the names (default ``*``)."""

    @classmethod
    def name(cls) -> str:
        return "file_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options["path"], self.options.get("glob", "*"))


def list_files(spark: SparkSession, path: str, glob: str = "*.tar.gz", host: str | None = None) -> DataFrame:
    """SRC8: the catalog of the archive files under ``path``, one partition a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileCatalog)
    files = spark.read.format("file_catalog").option("glob", glob).load(path)
    return files.withColumn("host", F.lit(host)) if host else files
