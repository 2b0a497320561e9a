"""Small documents and file hashes on the file system that the cluster shares."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHUNK = 8 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Spark writes it, and the path there."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):/", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if scheme else os.path.abspath(path)
    authority, _, inner = path[len(scheme[1]) + 1 :].lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme[1]}://{authority}/")
    return system, f"{base.rstrip('/')}/{inner}"


def write_document(spark: SparkSession, path: str, document: object) -> None:
    """A small document on any file system that Spark knows, replaced in one step: written beside its place, then renamed over it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    partial = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.partial")
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    parents = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$CreateOpts"), 1)
    parents[0] = getattr(hadoop, "Options$CreateOpts").createParent()
    out = context.create(partial, flags, parents)
    try:
        out.write((json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())
        out.hsync()
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(partial, target, overwrite)


def create_once(spark: SparkSession, path: str, document: object) -> bool:
    """Write a document where none is; false where another writer was first.

    A local path is created exclusively by the operating system, another by Hadoop's create without overwriting.
    """
    data = (json.dumps(document, sort_keys=True) + "\n").encode()
    system, where = file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(where), exist_ok=True)
        # Linked into place when written whole, so that nobody reads half a document.
        partial = f"{os.path.dirname(where)}/.{uuid.uuid4().hex}.partial"
        with open(partial, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(partial, where)
        except FileExistsError:
            return False
        finally:
            os.unlink(partial)
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    shared = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if shared.exists(target):
        return False
    try:
        out = shared.create(target, False)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    out.write(data)
    out.close()
    return True


def read_document(path: str) -> dict | None:
    """A small document, or null where there is none."""
    system, where = file_system(path)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(where) as f:
        return json.loads(f.read())


def names(path: str) -> list[str]:
    """Names of the documents in a folder, in order; hidden ones are not finished."""
    system, where = file_system(path)
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))


_TREE = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("ends_with_newline", pa.bool_())])
_LISTED = pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64())])


def hidden(name: str) -> bool:
    return any(part[:1] in ("_", ".") for part in name.split("/"))


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files at and below the paths of (path, name)."""
    for batch in batches:
        for path, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, where = file_system(path)
            top = system.get_file_info(where)
            found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
            rows = [(f"{path}{f.path[len(where) :]}", f"{name}{f.path[len(where) :]}", f.size) for f in found if f.type == fs.FileType.File]
            yield pa.RecordBatch.from_pylist([dict(zip(_LISTED.names, r, strict=True)) for r in rows if not hidden(r[1])], _LISTED)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of (path, name, bytes), read in chunks."""
    for batch in batches:
        rows = []
        for f in batch.to_pylist():
            system, where = file_system(f["path"])
            digest, last = hashlib.sha256(), b""
            with system.open_input_stream(where) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    last = chunk[-1:]
            rows.append({"name": f["name"], "bytes": f["bytes"], "sha256": digest.hexdigest(), "ends_with_newline": last == b"\n"})
        yield pa.RecordBatch.from_pylist(rows, _TREE)


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """name (below ``root``), bytes, sha256, ends_with_newline of every file of a tree, empty ones too.

    Names that Spark hides (``_x``, ``.x``) and what lies below them are left out; a file as ``root`` goes by its own name.
    The driver lists the first level alone, tasks what is below each entry; files are then dealt out by path and read in
    chunks of 8 MB, so a file may be of any size.
    """
    root = root.rstrip("/")
    system, where = file_system(root)
    if system.get_file_info(where).type == fs.FileType.File:
        entries = [(root, root.rsplit("/", 1)[-1])]
    else:
        entries = [(f"{root}/{f.base_name}", f.base_name) for f in system.get_file_info(fs.FileSelector(where)) if not hidden(f.base_name)]
    below = spark.createDataFrame(entries, "path string, name string").mapInArrow(listed, "path string, name string, bytes long")
    return below.repartition("path").mapInArrow(hashed, "name string, bytes long, sha256 string, ends_with_newline boolean")
