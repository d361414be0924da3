"""File-system steps that are no Spark job: what files a folder has, and commits by an atomic rename."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

COPY_BYTES = 1 << 20


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _path(spark: SparkSession, path: str):
    return _jvm(spark).org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Paths of the files below ``path`` whose names match ``glob``; none if the folder is missing. No file is opened."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        return sorted(r.path for r in found.select("path").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return []
        raise


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in ``path``; none if it is missing."""
    fs, p = _fs(spark, path), _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Move a file or folder in one step. False if ``target`` is there and may not be replaced."""
    from py4j.protocol import Py4JJavaError

    jvm = _jvm(spark)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, target).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), how)
    except Py4JJavaError as e:
        if not overwrite and "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this job made."""
    _fs(spark, path).delete(_path(spark, path), True)


def join_parts(spark: SparkSession, parts: list[str], target: str, head: bytes = b"") -> None:
    """One file from ``head`` and the bytes of ``parts``, in order: copied by a fixed buffer into a file beside ``target``,
    which then takes its place in one step, so a reader sees the old file or the whole new one."""
    fs = _fs(spark, target)
    new = f"{target}._joining"
    out = fs.create(_path(spark, new), True)
    try:
        out.write(bytearray(head))
        for part in parts:
            src = fs.open(_path(spark, part))
            try:
                _jvm(spark).org.apache.hadoop.io.IOUtils.copyBytes(src, out, COPY_BYTES, False)
            finally:
                src.close()
    finally:
        out.close()
    rename(spark, new, target, overwrite=True)
