"""Files of a source tree as rows."""

from __future__ import annotations

import codecs
import itertools
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.paths import file_ext
from sourceloom.operators.skew import TASK_BYTES, cut_lineage, spread

# Lower-case extension -> (language, type).
FILE_KINDS = {
    ".go": ("go", "source"),
    ".cs": ("csharp", "source"),
    ".csproj": ("csharp", "project"),
    ".sln": ("csharp", "solution"),
    ".mod": ("go", "module"),
}

# Fixed value: extensions read by default.
DEFAULT_EXTENSIONS = (".js", ".ts", ".go", ".rs", ".py", ".java")

# Parts of a file that are read in one go.
RANGE_PARTS = 32

# Files that pyarrow decompresses as it reads them, known by name.
_COMPRESSED = "[.](bz2|gz|lz4|zst)$"


def _list(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each folder, whatever its name."""
    for batch in batches:
        rows = []
        for folder in batch["path"]:
            store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            prefix = folder.partition("://")[0] + "://" if "://" in folder else ""
            for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                local = isinstance(store, fs.LocalFileSystem)
                if info.type == fs.FileType.Directory and not (local and os.path.islink(info.path)):
                    rows.append((prefix + _under(folder, inner, info.path), True, None))
                elif info.type == fs.FileType.File:
                    rows.append((prefix + _under(folder, inner, info.path), False, info.size))
        yield pd.DataFrame(rows, columns=["path", "folder", "length"]).astype({"length": "Int64", "folder": "boolean"})


def _under(folder: str, inner: str, path: str) -> str:
    """The path below a folder, written as the folder's name is."""
    return folder.partition("://")[2].rstrip("/") + path[len(inner.rstrip("/")):] if "://" in folder else path


def list_tree(spark: SparkSession, root: str, extensions: Iterable[str] | None = None) -> DataFrame:
    """``path, length`` of every file below ``root``; extensions are applied while listing.

    Folders are listed level by level, each level by Spark tasks. Links to folders are not
    followed, and folders that vanish meanwhile are empty.
    """
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        listed = cut_lineage(level.mapInPandas(_list, "path string, folder boolean, length bigint"))
        files = listed.where("not folder").select("path", "length")
        if extensions is not None:
            files = with_extensions(files, extensions)
        found = files if found is None else found.unionByName(files)
        level = listed.where("folder").select("path")
        if level.isEmpty():
            return found
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _read(file, size: int) -> bytes:
    """So many bytes, fewer at the end of the file only."""
    data = file.read(size)
    while len(data) < size and (more := file.read(size - len(data))):
        data += more
    return data


def _parts(store: fs.FileSystem, path: str, first: int, stop: int, size: int) -> Iterator[tuple[int, str]]:
    """Parts ``first`` to ``stop`` of a file as text, to its end if ``stop`` is 0.

    A part has ``size`` bytes; what is left at the end and shorter belongs to the last one. A
    character across two parts is in the later. Only its first byte can begin a character
    and it has four bytes at most, so three bytes before a part tell what goes on there, and
    joined the parts are the text of the whole file.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    with store.open_input_file(path) if first or stop else store.open_input_stream(path) as file:
        if first:
            before = min(3, first * size)
            file.seek(first * size - before)
            decoder.decode(_read(file, before))
        data = _read(file, size)
        if first and not data:  # it has become shorter
            return
        for part in itertools.count(first):
            if part + 1 == stop:
                yield part, decoder.decode(data)
                return
            more = _read(file, size)
            if len(more) < size:
                yield part, decoder.decode(data + more, True)
                return
            yield part, decoder.decode(data)
            data = more


def _whole(store: fs.FileSystem, path: str) -> Iterator[tuple[int, str]]:
    with store.open_input_stream(path) as file:
        yield 0, file.read().decode("utf-8", "replace")


def _ranges(files: DataFrame, part_bytes: int) -> DataFrame:
    """Files as ranges of ``RANGE_PARTS`` parts, dealt to a task per ``TASK_BYTES`` at least. What
    is compressed cannot be entered midway and is one range."""
    spark = files.sparkSession
    total = files.agg(F.sum("length")).first()[0] or 0
    n_parts = F.when(F.col("path").rlike(_COMPRESSED), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.floor(F.coalesce("length", F.lit(0)) / part_bytes))).cast("bigint")
    firsts = F.sequence(F.lit(0).cast("bigint"), n_parts - 1, F.lit(RANGE_PARTS).cast("bigint"))
    ranges = files.select("path", "length", n_parts.alias("n"), F.explode(firsts).alias("first"))
    stop = F.col("first") + RANGE_PARTS
    ranges = ranges.select("path", "length", "first", F.when(stop < F.col("n"), stop).otherwise(0).alias("stop"))
    return spread(ranges, max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))


def scan_tree(
    spark: SparkSession, root: str, extensions: Iterable[str] | None = None, skip_unreadable: bool = False,
    part_bytes: int | None = None,
) -> DataFrame:
    """``path, length, content`` of every file below ``root`` with one of ``extensions`` (of
    every file, if none are given).

    Only wanted files are opened. Bytes that are not UTF-8 become U+FFFD. Files that vanish
    while the job runs are skipped; unreadable ones fail the scan unless ``skip_unreadable``.
    ``list_tree`` gives the same rows without content.

    A task holds the files it reads one by one, each several times over. With ``part_bytes``
    rows are ``path, length, part, content``, a row per so many bytes of a file (the last part has
    up to twice as many, an empty file one part), and no task holds more than a part or two
    of a file, however large it is. Joined in order of ``part``, from 0 on, they are the file's text. Of a
    file that vanishes meanwhile some parts may be there.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, first, stop in zip(*(batch[c] for c in ("path", "length", "first", "stop")), strict=True):
                store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                texts = _whole(store, inner) if part_bytes is None else _parts(store, inner, first, stop, part_bytes)
                try:
                    for part, text in texts:
                        yield pd.DataFrame({"path": [path], "length": [length], "part": [part], "content": [text]})
                except FileNotFoundError:
                    continue
                except OSError:
                    if skip_unreadable:
                        continue
                    raise

    plain_path = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "")
    files = list_tree(spark, root, extensions)
    if part_bytes is None:
        whole = files.select("*", F.lit(0).alias("first"), F.lit(0).alias("stop"))
        ranges = whole.repartition(spark.sparkContext.defaultParallelism, "path")
    else:
        ranges = _ranges(files, part_bytes)
    found = ranges.mapInPandas(read, "path string, length bigint, part bigint, content string").withColumn("path", plain_path)
    return found.drop("part") if part_bytes is None else found


def with_extensions(
    files: DataFrame, extensions: Iterable[str] = DEFAULT_EXTENSIONS
) -> DataFrame:
    """Rows whose extension is listed; entries are trimmed and may lack the dot."""
    wanted = ["." + e.strip().removeprefix(".") for e in extensions]
    return files.where(file_ext("path").isin(wanted))


def _kind(ext: Column, index: int) -> Column:
    pairs = [F.lit(x) for k, v in FILE_KINDS.items() for x in (k, v[index])]
    return F.try_element_at(F.create_map(*pairs), ext)


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``language`` and ``type``; rows with any other extension are dropped.

    Five fixed kinds are a literal map, so classification is a map-only projection.
    """
    ext = F.lower(file_ext("path"))
    return files.where(ext.isin(list(FILE_KINDS))).select(
        "*", _kind(ext, 0).alias("language"), _kind(ext, 1).alias("type")
    )


def split_rejects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with a ``reason``."""
    marked = files.withColumn(
        "reason",
        F.when(F.coalesce("content", F.lit("")) == "", "empty file content").when(
            file_ext("path").isin("", "."), "file has no extension"
        ),
    )
    return marked.where(F.isnull("reason")).drop("reason"), marked.where(F.isnotnull("reason"))
