"""File trees as tables: listed and hashed inside tasks, and written from payload tables.

A listing goes down level by level. The folders of a level are rows, dealt to tasks; a task lists its folders, and
the folders found are the rows of the next level. So no list of names passes the driver, a folder of any size is one
task's stream, and empty files are rows like all others. Contents are hashed as streams in a second pass, dealt by size, so
a file may be larger than any value.

Tasks open the tree themselves, so it has to lie where every executor sees it: a mounted folder, or a store that
``pyarrow.fs`` opens by its address.
"""

from __future__ import annotations

import hashlib
import math
import os
import stat
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Folders, and bytes and files, that one task takes.
TASK_FOLDERS, TASK_BYTES, TASK_FILES = 64, 512 << 20, 2_000
READ_BYTES, BATCH_ROWS = 1 << 20, 10_000


def _local(root: str) -> str | None:
    """The path of a mounted folder; None for another store."""
    parts = urlsplit(root)
    if not parts.scheme:
        return root
    return unquote(parts.path) if parts.scheme == "file" else None


def _store(root: str):
    """(file system, path below it) of a root that is not mounted."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _children(root: str, folder: str) -> Iterator[tuple[str, str, int]]:
    """(path, object type, size) of what a folder holds; nothing is followed."""
    base = _local(root)
    prefix = f"{folder}/" if folder else ""
    if base is not None:
        with os.scandir(os.path.join(base, folder)) as entries:
            for entry in entries:
                info = entry.stat(follow_symlinks=False)
                kind = "directory" if stat.S_ISDIR(info.st_mode) else "file" if stat.S_ISREG(info.st_mode) else "symlink" if stat.S_ISLNK(info.st_mode) else "special"
                yield prefix + entry.name, kind, info.st_size if kind == "file" else 0
        return
    from pyarrow import fs

    system, top = _store(root)
    for info in system.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/"))):
        kind = {fs.FileType.Directory: "directory", fs.FileType.File: "file"}.get(info.type, "special")
        yield prefix + info.base_name, kind, info.size or 0 if kind == "file" else 0


def _digest(root: str, path: str) -> tuple[int, str]:
    """Bytes and digest of a file, read as a stream."""
    base, state, size = _local(root), hashlib.sha256(), 0
    if base is not None:
        opened = open(os.path.join(base, path), "rb")
    else:
        system, top = _store(root)
        opened = system.open_input_stream(f"{top.rstrip('/')}/{path}")
    with opened as source:
        while block := source.read(READ_BYTES):
            state.update(block)
            size += len(block)
    return size, state.hexdigest()


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, object_type, size)`` of everything below ``root``; types are file, directory, symlink and special.

    One round for each level of the tree. An absent root is an error, an empty one gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int]] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["path", "object_type", "size"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for child in _children(root, folder):
                    rows.append(child)
                    if len(rows) == BATCH_ROWS:
                        yield flush()
                        rows = []
        if rows:
            yield flush()

    levels: list[DataFrame] = []
    folders, count = spark.range(1).select(F.lit("").alias("path")), 1
    while count:
        dealt = folders.repartition(max(1, math.ceil(count / TASK_FOLDERS)), "path")
        level = stored(dealt.mapInArrow(run, "path string, object_type string, size long"), "tree-level")
        levels.append(level)
        folders = level.where("object_type = 'directory'").select("path")
        count = folders.count()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def with_digests(files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``path`` below ``root``, its ``size`` and ``sha256`` as they are read."""
    total = files.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, math.ceil(total[0] / TASK_FILES), math.ceil((total[1] or 0) / TASK_BYTES))
    rest = [name for name in files.columns if name not in ("size", "sha256")]
    at = rest.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [_digest(root, path) for path in batch.column(at).to_pylist()]
            told = [pa.array([r[0] for r in read], pa.int64()), pa.array([r[1] for r in read], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*rest, "size", "sha256"])

    kinds = dict(files.dtypes)
    schema = ", ".join([*[f"`{name}` {kinds[name]}" for name in rest], "size long", "sha256 string"])
    return files.select(*rest).repartition(tasks, "path").mapInArrow(run, schema)


def scan_payload_tree(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """Regular files below ``root``: ``(bundle_id, path, size, sha256)``.

    The first ``depth`` folders name the bundle, the rest is the path. Files above that depth belong to no
    bundle and are left out, as are links and special files, which :func:`scan_listing` tells.
    """
    files = list_tree(spark, root).where("object_type = 'file'").where(F.size(F.split("path", "/")) > depth)
    return _owned(with_digests(files.select("path", "size"), root), depth).select("bundle_id", "path", "size", "sha256")


def scan_listing(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``(bundle_id, path, object_type)`` of everything inside the bundles below ``root``."""
    inside = list_tree(spark, root).where(F.size(F.split("path", "/")) > depth)
    return _owned(inside, depth).select("bundle_id", "path", "object_type")


def _owned(found: DataFrame, depth: int) -> DataFrame:
    parts = F.split("path", "/")
    bundle = F.array_join(F.slice(parts, 1, depth), "/")
    return found.withColumns({"bundle_id": bundle, "path": F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), "/")})


def write_tree(payload: DataFrame, root: str) -> None:
    """Write ``(bundle_id, path, content)`` as files below ``root``; rows of null content are no files.

    A file is written under a name of its attempt and then moved to its own, so attempts that run twice or are lost
    leave whole files only. Paths have to be sound (``path_profile_audit``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _local(root)
        if base is None:
            from pyarrow import fs

            system, top = _store(root)
        else:
            top = base
        for batch in batches:
            for bundle, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if content is None:
                    continue
                data = content.encode() if isinstance(content, str) else content
                target = f"{top.rstrip('/')}/{bundle}/{path}"
                folder, part = target.rsplit("/", 1)[0], f"{top.rstrip('/')}/.attempt-{uuid.uuid4().hex}"
                if base is not None:
                    os.makedirs(folder, exist_ok=True)
                    with open(part, "wb") as out:
                        out.write(data)
                    os.replace(part, target)
                else:
                    system.create_dir(folder, recursive=True)
                    with system.open_output_stream(part) as out:
                        out.write(data)
                    system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["rows"])

    os.makedirs(_local(root), exist_ok=True) if _local(root) is not None else _make(root)
    payload.select("bundle_id", "path", "content").mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def _make(root: str) -> None:
    system, top = _store(root)
    system.create_dir(top, recursive=True)
