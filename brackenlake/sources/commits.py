"""Versions of a table's state: small JSON documents under one folder, each committed by one rename that fails if the version is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are committed, ascending."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, folder: str, version: int) -> dict:
    fs, at = _fs(spark, f"{folder}/{version:08d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, version: int, state: dict) -> None:
    """Write a version whole under another name and rename it; FileExistsError if another writer was first."""
    name = f"{folder}/{version:08d}.json"
    fs, at = _fs(spark, name)
    _, draft = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(rename, 1)
    none[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, at, none)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(at):
            raise FileExistsError(f"version {version} was committed by another writer") from e
        raise


def texts_named(spark: SparkSession, root: str, name: str) -> list[tuple[str, str]]:
    """(folder below the root or '', text) of all files of a name in a tree, hidden ones too, which Spark's own listing leaves out."""
    fs, at = _fs(spark, root)
    top = fs.makeQualified(at).toUri().getPath().rstrip("/")
    out, found = [], fs.listFiles(at, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName() == name:
            stream = fs.open(path)
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append((path.getParent().toUri().getPath()[len(top) :].strip("/"), text))
    return sorted(out)


def children(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """A name for the state of some files: their paths, lengths and times."""
    import hashlib

    h = hashlib.sha256()
    for f in sorted(files):
        fs, at = _fs(spark, f)
        s = fs.getFileStatus(at)
        h.update(f"{f}:{s.getLen()}:{s.getModificationTime()};".encode())
    return h.hexdigest()[:24]
