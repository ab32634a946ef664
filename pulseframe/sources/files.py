"""Byte-range access to the storage Spark lists, from inside a task, and folder listings as tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import scalars as fx
from pulseframe.session import ship_package


def resolve(path: str):
    """(file system, path on it) of a Spark path or URI."""
    from pyarrow import fs

    if re.match(r"^file:/", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path)
    match = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]*)(/.*)?$", path)
    if match is None:
        return fs.LocalFileSystem(), path
    scheme, authority, rest = match.groups()
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, base.rstrip("/") + (rest or "")


def is_reachable(path: str) -> bool:
    """Whether ``pyarrow.fs`` knows the store of a path."""
    try:
        resolve(path)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def open_ranged(path: str):
    """Random-access input file; reads fetch only the asked bytes."""
    system, inner = resolve(path)
    return system.open_input_file(inner)


def open_sequential(path: str):
    system, inner = resolve(path)
    return system.open_input_stream(inner, compression=None)


def write_whole(path: str, data: bytes) -> None:
    """A file that appears complete or not at all: written aside, then renamed."""
    system, inner = resolve(path)
    folder, name = inner.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    aside = f"{folder}/.{name}.part"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(data)
    system.move(aside, inner)


def write_files(root: str, files: dict[str, bytes]) -> None:
    """Files by their names below ``root``, each of which appears as with ``write_whole``.

    Empty folders that lie there from before and are not asked for are renamed to those that are. That is much less to a
    disk than making folders and removing them: each takes a block of its own, which some disks are told of when it is freed.
    """
    from pyarrow import fs

    system, inner = resolve(root)
    paths = {f"{inner}/{name}": data for name, data in files.items()}
    folders = {path.rsplit("/", 1)[0] for path in paths}
    above = {folder.rsplit("/", 1)[0] for folder in folders}
    for folder in above:
        system.create_dir(folder, recursive=True)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    there = {i.path for i in found if i.type == fs.FileType.Directory}
    spare = list(there - folders - above - {i.path.rsplit("/", 1)[0] for i in found})
    for folder in folders - there:
        if spare:
            try:
                system.move(spare.pop(), folder)
                continue
            except (OSError, NotImplementedError):  # another attempt took it, or the store has no folders to rename
                pass
        system.create_dir(folder, recursive=True)
    for path, data in paths.items():
        folder, name = path.rsplit("/", 1)
        aside = f"{folder}/.{name}.part"
        with system.open_output_stream(aside, compression=None) as out:
            out.write(data)
        system.move(aside, path)


def _removed(named: DataFrame, remove: Callable) -> None:
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    remove(*resolve(path))
                except FileNotFoundError:
                    pass
            yield batch

    ship_package(named.sparkSession)
    named.select("path").mapInArrow(run, "path STRING").write.format("noop").mode("overwrite").save()


def remove_folders(named: DataFrame) -> None:
    """Remove the folders of ``named(path)`` with all that is in them, in parallel; one that is gone already is passed over."""
    _removed(named, lambda system, inner: system.delete_dir(inner))


def remove_files_in(named: DataFrame) -> None:
    """Remove all files below the folders of ``named(path)``, in parallel; the folders stay, for ``write_files``."""
    def remove(system, inner):
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            if info.type == fs.FileType.File:
                system.delete_file(info.path)

    _removed(named, remove)


def _unhidden(name: str) -> bool:
    return not name.startswith(("_", "."))


def _rows(parent: str, prefix: str, infos) -> pa.RecordBatch:
    from pyarrow import fs

    return pa.RecordBatch.from_pydict({
        "parent": [parent] * len(infos), "path": [prefix + i.path for i in infos],
        "is_dir": [i.type == fs.FileType.Directory for i in infos], "length": [i.size or 0 for i in infos],
        "modificationTime": [None if i.mtime_ns is None else i.mtime_ns // 1000 for i in infos]}, schema=_LISTED)


_LISTED = pa.schema([("parent", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()),
                     ("modificationTime", pa.timestamp("us", "UTC"))])
_LISTED_DDL = "parent STRING, path STRING, is_dir BOOLEAN, length BIGINT, modificationTime TIMESTAMP"
_BATCH_ROWS = 10_000
_BATCH_BYTES = 8 << 20


def _batches(parent: str, prefix: str, infos):
    for low in range(0, len(infos), _BATCH_ROWS):
        yield _rows(parent, prefix, infos[low:low + _BATCH_ROWS])


def joined(batches, rows: int = _BATCH_ROWS, size: int = _BATCH_BYTES):
    """The same rows in batches of ``rows`` or ``size`` bytes and more: handing a batch to Spark costs as much as thousands of rows."""
    held, count, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        count, held_bytes = count + batch.num_rows, held_bytes + batch.nbytes
        if count >= rows or held_bytes >= size:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, count, held_bytes = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _children(path: str):
    """Entries directly in a folder, hidden ones left out; a file is its own only entry."""
    from pyarrow import fs

    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.Directory:
        infos = [i for i in system.get_file_info(fs.FileSelector(inner)) if _unhidden(i.base_name)]
    else:
        infos = [info]
    return _batches(path, path[:len(path) - len(inner)], sorted(infos, key=lambda i: i.path))


def _files_below(path: str):
    from pyarrow import fs

    system, inner = resolve(path)
    infos = [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True))
             if i.type == fs.FileType.File and all(map(_unhidden, i.path[len(inner) + 1:].split("/")))]
    return _batches(path, path[:len(path) - len(inner)], sorted(infos, key=lambda i: i.path))


def list_children(folders: DataFrame) -> DataFrame:
    """``parent, path, is_dir, length, modificationTime`` of everything directly in the folders of ``folders(path)``.

    Folders are listed in parallel; empty files and folders are listed too.
    """
    ship_package(folders.sparkSession)

    def run(batches):
        return joined(listed for batch in batches for path in batch.column(0).to_pylist() for listed in _children(path))

    return folders.select("path").mapInArrow(run, _LISTED_DDL)


def existing_files(named: DataFrame) -> DataFrame:
    """The rows of ``named(id, path)`` whose path is a file; paths are looked at in parallel, no folder is listed."""
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column(1).to_pylist():
                system, inner = resolve(path)
                found.append(system.get_file_info(inner).type == fs.FileType.File)
            yield batch.filter(pa.array(found, pa.bool_()))

    ship_package(named.sparkSession)
    return named.select("id", "path").mapInArrow(run, "id STRING, path STRING")


def roots(spark: SparkSession, path) -> DataFrame:
    """``(path)`` of the folders or files that a path, a pattern or a list of them names, as Spark spells them."""
    found = []
    for one in [path] if isinstance(path, str) else path:
        whole = qualify(spark, one)
        if re.search(r"[*?\[{]", whole):
            pattern = spark._jvm.org.apache.hadoop.fs.Path(whole)
            matches = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
            found += [status.getPath().toString() for status in matches]
        else:
            found.append(whole)
    return spark.createDataFrame([(f,) for f in found], "path STRING")


def matches_glob(name: Column, glob: str) -> Column:
    """File name patterns with ``*``, ``?`` and ``[...]``."""
    pattern = "".join({"*": ".*", "?": "."}.get(p) or (p if p.startswith("[") else re.escape(p))
                      for p in re.findall(r"\[[^\]]*\]|.", glob))
    return name.rlike(f"^{pattern}$")


def list_files(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``path, length, modificationTime`` of every file below ``path``, empty files included.

    The folders below the first level are listed in parallel; no file is opened.
    """
    def below(batches):
        for batch in batches:
            yield batch.filter(pc.invert(batch.column(2)))
            for folder in batch.filter(batch.column(2)).column(1).to_pylist():
                yield from _files_below(folder)

    def expand(batches):
        return joined(below(batches))

    first = list_children(roots(spark, path)).repartition(spark.sparkContext.defaultParallelism)
    files = first.mapInArrow(expand, _LISTED_DDL)
    if glob is not None:
        files = files.where(matches_glob(fx.base_name(F.col("path")), glob))
    return files.select("path", "length", "modificationTime")


def qualify(spark: SparkSession, root: str) -> str:
    """Root in the spelling Spark's listings use, without a trailing slash."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(jvm_path).toString().rstrip("/")


def relative_to(path, root: str):
    """Part of a path column below ``root``."""
    return path.substr(F.lit(len(root) + 2), F.length(path))


def read_listing(spark: SparkSession, unconverted: str, converted: str, processed: str) -> DataFrame:
    """``listing``: one row per experiment folder and stage with the folder's own time in ms; empty folders count.

    A store that keeps no times of folders gives null times, which count as 0.
    """
    named = [(stage, qualify(spark, root)) for stage, root in
             (("unconverted", unconverted), ("converted", converted), ("processed", processed))]
    stages = spark.createDataFrame(named, "stage STRING, path STRING").repartition(len(named), "stage")

    def run(batches):
        for batch in batches:
            for stage, root in zip(*(c.to_pylist() for c in batch.columns)):
                for listed in _children(root):
                    folders = listed.filter(listed.column(2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(stage), len(folders)), folders.column(1), folders.column(4)],
                        names=["stage", "path", "moment"])

    ship_package(spark)
    found = stages.mapInArrow(run, "stage STRING, path STRING, moment TIMESTAMP")
    return found.select("stage", F.substring_index("path", "/", -1).alias("id"),
                        F.coalesce(fx.timestamp_to_ms(F.col("moment")), F.lit(0.0)).alias("mtime_ms"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``manifest(id, path, file_name, depth)``: files below each experiment folder of one stage."""
    inside = relative_to(F.col("path"), qualify(spark, root))
    parts = F.split(inside, "/")
    return (
        list_files(spark, root)
        .where(inside.contains("/"))
        .select(
            parts[0].alias("id"),
            "path",
            F.element_at(parts, -1).alias("file_name"),
            (F.size(parts) - F.lit(1)).alias("depth"),
        )
    )


def read_direct_files(spark: SparkSession, root: str) -> DataFrame:
    """``manifest`` of the files directly in each experiment folder of one stage: one listing a folder."""
    top = list_children(roots(spark, root)).where("is_dir").repartition(spark.sparkContext.defaultParallelism)
    files = list_children(top).where(~F.col("is_dir"))
    return files.select(
        F.substring_index("parent", "/", -1).alias("id"), "path",
        F.substring_index("path", "/", -1).alias("file_name"), F.lit(1).alias("depth"))
