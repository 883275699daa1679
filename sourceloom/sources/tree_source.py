"""A source tree as a Spark data source: ``spark.read.format("source_tree")``.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("path", root).option("extensions", "go,py").load()

Rows are ``path, length, content``; with the option ``content`` ``false`` they are ``path,
length`` and no file is opened. Planning lists the first ``PLAN_FOLDERS`` folders of the tree,
level by level, and deals their files to tasks by number: small folders share a task, a large
one is split among several. What lies deeper is listed by the tasks, a subtree each. No
folder is listed by a Spark job of its own, and nothing is checkpointed.

Extensions, and a part that paths shall contain (``containing``), are options, so files without
them are never opened. Filters are not pushed down: Spark 4.1 keeps what was pushed with
the frame, and a second query on the same frame would miss rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLAN_FOLDERS = 256
FILES_PER_TASK = 2_000

Entry = tuple[str, bool, int]


def entries(folder: str) -> Iterator[Entry]:
    """``name with folder, is a folder, length`` of what lies directly in a folder; nothing if it is
    gone. Links to folders are not followed. Local folders are read as a stream."""
    store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    base = folder.rstrip("/")
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(inner) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield f"{base}/{e.name}", True, 0
                    elif e.is_file():
                        yield f"{base}/{e.name}", False, e.stat().st_size
        except FileNotFoundError:
            return
        return
    for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield f"{base}/{info.base_name}", info.type == fs.FileType.Directory, info.size or 0


def plain(path: str) -> str:
    """A path without the scheme."""
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "", path)


def extension(path: str) -> str:
    """As ``functions.paths.file_ext``."""
    name = path.rsplit("/", 1)[-1]
    return name[name.rindex("."):] if "." in name else ""


@dataclass
class Walk(InputPartition):
    """Files of some folders: of whole subtrees if ``deep``, else those lying directly in them
    whose number by name is ``share`` of ``shares``."""

    folders: list[str]
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], content: bool) -> None:
        self.root = options["path"].rstrip("/") or "/"
        named = options.get("extensions")
        self.extensions = None if named is None else {"." + e.strip().removeprefix(".") for e in named.split(",")}
        self.content = content
        self.skip_unreadable = options.get("skip_unreadable", "false").lower() == "true"
        self.containing = options.get("containing", "")

    def wanted(self, path: str) -> bool:
        return (self.extensions is None or extension(path) in self.extensions) and self.containing in plain(path)

    def partitions(self) -> list[InputPartition]:
        ahead, out = [self.root], []
        shared, files = [], 0
        for _ in range(PLAN_FOLDERS):
            if not ahead:
                break
            folder, own = ahead.pop(0), 0
            for path, is_folder, _ in entries(folder):
                if is_folder:
                    ahead.append(path)
                elif self.wanted(path):
                    own += 1
            if own > FILES_PER_TASK:
                shares = -(-own // FILES_PER_TASK)
                out += [Walk([folder], False, k, shares) for k in range(shares)]
            elif own:
                shared.append(folder)
                files += own
                if files >= FILES_PER_TASK:
                    out.append(Walk(shared, False))
                    shared, files = [], 0
        if shared:
            out.append(Walk(shared, False))
        return out + [Walk([folder], True) for folder in ahead] or [Walk([], False)]

    def read(self, partition: Walk) -> Iterator[tuple]:
        ahead = list(partition.folders)
        while ahead:
            for path, is_folder, length in entries(ahead.pop()):
                if is_folder:
                    if partition.deep:
                        ahead.append(path)
                elif zlib.crc32(path.encode()) % partition.shares == partition.share and self.wanted(path):
                    if not self.content:
                        yield plain(path), length
                    elif (text := self.text(path)) is not None:
                        yield plain(path), length, text

    def text(self, path: str) -> str | None:
        """The file as text, bytes that are not UTF-8 as U+FFFD; None if it is gone."""
        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        try:
            with store.open_input_stream(inner) as file:
                return file.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return None
        except OSError:
            if self.skip_unreadable:
                return None
            raise


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() != "false"

    def schema(self) -> str:
        return "path string, length bigint" + ", content string" * self._content()

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options, self._content())


def read_tree(
    spark: SparkSession, root: str, extensions: Iterable[str] | None = None, content: bool = True,
    skip_unreadable: bool = False, containing: str = "",
) -> DataFrame:
    """``path, length`` and, if asked for, ``content`` of every file below ``root``, as
    ``sources.tree.scan_tree`` and ``list_tree`` give them. Files that vanish are skipped;
    unreadable ones fail the job unless ``skip_unreadable``."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").options(
        path=root, content=str(content).lower(), skip_unreadable=str(skip_unreadable).lower(), containing=containing
    )
    if extensions is not None:
        reader = reader.option("extensions", ",".join(extensions))
    return reader.load()
