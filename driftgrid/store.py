"""Small files of the driver on Hadoop's file systems: local paths and URIs alike, so that executors see what the driver writes.

A write goes to a name of its own and is renamed over the target in one step; a reader sees the former bytes or the new ones.

Defined results: a missing file or folder is an error to read and empty to list; folders are made where they are needed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def is_uri(path: str | Path) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", str(path)))


def join(root: str | Path, *names: str) -> str:
    return "/".join([str(root).rstrip("/"), *names])


def _session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without one and use a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="driftgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def delete_at_exit(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.deleteOnExit(at)


def exists(path: str) -> bool:
    system, at = file_system(_session(), path)
    return bool(system.exists(at))


def names(folder: str) -> list[str]:
    """The names of the files in a folder."""
    system, at = file_system(_session(), folder)
    return [s.getPath().getName() for s in system.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(".")] if system.exists(at) else []


def read(path: str) -> bytes:
    spark = _session()
    system, at = file_system(spark, path)
    if not system.exists(at):
        raise FileNotFoundError(path)
    stream = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, at most n."""
    system, at = file_system(spark, path)
    stream = system.open(at)
    try:
        got = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(x for x in got if x >= 0)


def as_it_is(spark: SparkSession, path: str) -> dict[str, str]:
    """Options by which Spark's line reader takes a file's bytes as they are, where its name would have them unpacked. Such a file is not split."""
    codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress
    _, at = file_system(spark, path)
    codec = codecs.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(at)
    plain = codecs.PassthroughCodec
    return {} if codec is None else {"io.compression.codecs": plain.CLASSNAME, plain.OPT_EXTENSION: codec.getDefaultExtension()}


def write(path: str, body: bytes) -> None:
    spark = _session()
    jvm = spark.sparkContext._jvm
    system, at = file_system(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    # a sum file beside a local one would go stale if the file is changed by hand
    system.setWriteChecksum(False)
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(body))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(beside), system.makeQualified(at), options)
