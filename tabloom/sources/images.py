"""Catalogues of image files from folders and ZIP archives."""

from __future__ import annotations

import io
import os
import re
import zipfile
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.ordering import head

# Image file extensions, and the longest file name kept.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif")
LONGEST_NAME = 150

ENTRY_SCHEMA = (
    "archive string, filename string, disk_filename string, file_path string, "
    "extension string, size_bytes bigint"
)


def _extension(name):
    return F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]*)$", 1))


def read_folder(
    spark: SparkSession, folder: str, scan_subfolders: bool = False, max_images: int = 0,
    dimensions: bool = False,
) -> DataFrame:
    """Image files of a folder in path order; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(bool(scan_subfolders)).lower()).load(folder)
    )
    path = F.regexp_replace("path", "^file:(//)?", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    listed = files.select(
        name.alias("filename"), name.alias("disk_filename"), path.alias("file_path"),
        _extension(name).alias("extension"), F.col("length").alias("size_bytes"),
    ).filter(F.col("extension").isin(*EXTENSIONS))
    if listed.isEmpty():
        raise ValueError(f"no image files in {folder}")
    if dimensions:
        listed = add_dimensions(spark, listed, folder, scan_subfolders)
    return head(listed, max_images, "file_path") if max_images > 0 else listed.orderBy("file_path")


def add_dimensions(
    spark: SparkSession, listed: DataFrame, folder: str, scan_subfolders: bool = False
) -> DataFrame:
    """Width and height of every file, null when it cannot be read as an image."""
    images = (
        spark.read.format("image").option("dropInvalid", True)
        .option("recursiveFileLookup", str(bool(scan_subfolders)).lower()).load(folder)
    )
    sizes = images.select(
        # The origin is URL-encoded, where a plus sign stands for itself.
        F.url_decode(F.replace(F.regexp_replace("image.origin", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
        .alias("_origin"),
        F.col("image.width").alias("width"), F.col("image.height").alias("height"),
    )
    return listed.join(sizes, F.col("file_path") == F.col("_origin"), "left").drop("_origin")


#: Schemes whose files are read in place; archives elsewhere are loaded through Spark.
_SEEKABLE = ("file", "s3", "s3a", "gs", "hdfs")
ENTRIES_AT_ONCE = 10_000


def _scheme(path: str) -> str:
    return path.split(":", 1)[0].lower() if re.match(r"[A-Za-z][\w+.-]*:", path) else "file"


def open_seekable(path: str):
    """A file opened for reads at any place, on this machine or in an object store or HDFS."""
    scheme = _scheme(path)
    if scheme == "file":
        return open(re.sub("^file:(//)?(?=/)", "", path), "rb")
    files, name = pyarrow.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    return files.open_input_file(name)


@lru_cache(maxsize=4)
def _archive(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(open_seekable(path))


def read_bytes(path: str | None) -> bytes | None:
    """A file, or an entry of an archive (``archive!/entry``), as bytes; None when there is no such file."""
    archive, mark, entry = (path or "").partition("!/")
    try:
        if mark and not _exists(path):
            return _archive(archive).read(entry)
        with open_seekable(path or "") as file:
            return file.read()
    except (OSError, KeyError):
        return None


def _exists(path: str) -> bool:
    """Whether a local file has the mark of an entry in its own name."""
    return _scheme(path) == "file" and os.path.exists(re.sub("^file:(//)?(?=/)", "", path))


def _entries(archive: str, file):
    """Image entries by the archive's directory, which lies at its end; the entries themselves are not read."""
    taken: dict[str, int] = {}
    with zipfile.ZipFile(file) as packed:
        for entry in packed.infolist():
            name = os.path.basename(entry.filename)
            stem, extension = os.path.splitext(name)
            if entry.is_dir() or extension.lower() not in EXTENSIONS:
                continue
            if len(name) > LONGEST_NAME:
                stem = stem[: LONGEST_NAME - len(extension)]
            disk = stem + extension
            seen = taken[disk] = taken.get(disk, -1) + 1
            if seen:
                disk = f"{stem}_{seen}{extension}"
            yield archive, name, disk, f"{archive}!/{entry.filename}", extension.lower(), entry.file_size


def read_archives(spark: SparkSession, path: str, max_images: int = 0) -> DataFrame:
    """Image entries of all ZIP archives at a path; equal names inside one archive get a counter.

    Spark lists the archives; a task opens one at a time and reads its directory only, so memory does not follow the size of
    an archive. Where files cannot be read in place (a scheme known to Spark alone), they are loaded. A file that is no
    archive raises; a path without files gives an empty table or Spark's own error.
    """
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").first()
    in_place = first is None or _scheme(first["path"]) in _SEEKABLE
    columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def expand(batches):
        for batch in batches:
            contents = [None] * len(batch) if in_place else batch["content"]
            for name, content in zip(batch["path"], contents):
                with open_seekable(name) if in_place else io.BytesIO(content) as file:
                    rows = _entries(name.removeprefix("file:"), file)
                    while some := list(islice(rows, ENTRIES_AT_ONCE)):
                        yield pd.DataFrame(some, columns=columns)

    files = listed.select("path") if in_place else listed.select("path", "content")
    entries = files.mapInPandas(expand, ENTRY_SCHEMA)
    return head(entries, max_images, "file_path") if max_images > 0 else entries
