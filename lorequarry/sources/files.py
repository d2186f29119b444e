"""Paths and files: confinement to a root, whole-file reads, and writes from the executors."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import posixpath
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators.common import cut

WRITTEN = "rel_path string, n_bytes long, content_sha256 string"


class Outside(ValueError):
    """A path that leads out of its root."""


def relative(path: str) -> str:
    """path as a normal relative path; absolute paths and those that climb out of their root are refused."""
    norm = posixpath.normpath(path.replace("\\", "/"))
    if not path or norm in (".", "..") or norm.startswith(("/", "../")) or re.match("[A-Za-z]:", norm) or "\x00" in path:
        raise Outside(path)
    return norm


def confined(root: str | Path, path: str) -> Path:
    """The local file below root that path names. Links are resolved first, so one that leads outside is refused."""
    top = Path(root).resolve()
    found = (top / relative(path)).resolve()
    if not found.is_relative_to(top):
        raise Outside(path)
    return found


def inside(rel_path: Column) -> Column:
    """Whether a relative path stays below its root, as a column."""
    return rel_path.isNotNull() & (rel_path != "") & ~rel_path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a generated folder before it is published anew (never a file system's root)."""
    fs, p = _hadoop(spark, path)
    if p.isRoot():
        raise Outside(path)
    fs.delete(p, True)


def empty_files(spark: SparkSession, root: str, glob: str) -> list[str]:
    """Relative paths of the files without a byte, which Spark's readers leave out."""
    fs, top = _hadoop(spark, root)
    base = top.toUri().getPath().rstrip("/") + "/"
    if fs.getScheme() == "file":
        return sorted(p.relative_to(base).as_posix() for p in Path(base).rglob(glob) if p.is_file() and not p.is_symlink() and not p.stat().st_size)
    found, listed = [], fs.listFiles(top, True)
    while listed.hasNext():
        f = listed.next()
        if not f.getLen() and fnmatch.fnmatchcase(f.getPath().getName(), glob):
            found.append(f.getPath().toUri().getPath().removeprefix(base))
    return sorted(found)


def symbolic_links(spark: SparkSession, root: str) -> list[str]:
    """Relative paths of the symbolic links below a local root (other file systems are read by Spark without any); none is followed."""
    fs, top = _hadoop(spark, root)
    if fs.getScheme() != "file":
        return []
    base, found = top.toUri().getPath(), []
    for folder, folders, names in os.walk(base, followlinks=False):
        found += [Path(folder, n).relative_to(base).as_posix() for n in folders + names if Path(folder, n).is_symlink()]
    return sorted(found)


def read_whole(spark: SparkSession, root: str, glob: str = "*", text: bool = True) -> DataFrame:
    """path (relative to root) and content of every file below root that glob matches; no rows where root isn't there.

    What is reached through a symbolic link below root, be it a file or a folder, is left out, wherever the link leads.

    text: content is the file as one string; else its bytes. One row a file, read by the executors.
    """
    kind = "string" if text else "binary"
    if not exists(spark, root):
        return spark.createDataFrame([], f"path string, content {kind}")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = reader.format("binaryFile").load(root)
    base = _hadoop(spark, root)[1].toUri().getPath().rstrip("/") + "/"
    full = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    full = F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B")))
    out = rows.select(F.substring(full, F.lit(len(base) + 1), F.length(full)).alias("path"), F.col("content").cast(kind).alias("content"))
    if links := symbolic_links(spark, root):
        # a path's beginnings: a, a/b, a/b/c
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        out = out.where(~F.arrays_overlap(above, F.lit(links)))
    if empty := empty_files(spark, root, glob):
        none = spark.createDataFrame([(p,) for p in empty], "path string").withColumn("content", F.lit("").cast(kind))
        out = out.unionByName(none)
    return out


def write_whole(files: DataFrame, root: str) -> DataFrame:
    """Write rel_path, content as files below root and return what was written (rel_path, n_bytes, content_sha256).

    The executors write, through pyarrow's file systems, so nothing is gathered. A file's name and bytes follow from its row,
    so a task that runs again writes the same. Paths out of the root are refused. The result is computed once, by a write to the
    shared work folder, and read from there; nothing but the files is left below root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        made: set[str] = set()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = (pfs.LocalFileSystem(), root.removeprefix("file://")) if root.startswith("file://") else pfs.FileSystem.from_uri(root)
                name = f"{base}/{relative(path)}"
                if (folder := posixpath.dirname(name)) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (content or "").encode()
                with fs.open_output_stream(name, compression=None) as f:
                    f.write(data)
                rows.append((path, len(data), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["rel_path", "n_bytes", "content_sha256"])

    root = qualified(root)
    return cut(files.select("rel_path", "content").mapInArrow(run, WRITTEN), "written")


def qualified(path: str) -> str:
    """path with its scheme, not encoded, as Spark's readers take it; a plain path is a local one."""
    return path.rstrip("/") if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) else f"file://{Path(path).resolve()}"
