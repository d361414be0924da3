"""Helpers shared by the operators: word rules, staged tables, per-worker state, label folds."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoscope.session import checkpoint_dir

# the white space of every text contract here: U+0020 and U+0009..U+000D
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def without_spaces(c: Column) -> Column:
    """Delete every character of SPACES (byte search per character; no regular expression)."""
    for s in SPACES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def n_words(c: Column) -> Column:
    """How many words the text has; null counts as none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def n_of(c: Column, *chars: str) -> Column:
    """How often any of ``chars`` (one byte each) occurs."""
    left = c
    for ch in chars:
        left = F.replace(left, F.lit(ch), F.lit(""))
    return (F.octet_length(c) - F.octet_length(left)).cast("long")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; Hadoop deletes it when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: the lineage is cut,
    a lost executor costs a read, and columns and filters still reach the scan."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _placed(df: DataFrame) -> DataFrame:
    at = df.metadataColumn("_metadata")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"), at["file_path"].alias("_file"), at["row_index"].alias("_row"))


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a place in files, else a copy in the shared folder."""
    try:
        _placed(docs).schema
        return docs
    except AnalysisException:  # no file scan below: there is no such hidden column
        return staged(docs, "docs")


def located(docs: DataFrame) -> DataFrame:
    """Rows (``_doc`` struct of all columns, ``_file``, ``_row``): where each row of ``on_files`` lies."""
    return _placed(docs)


SIEVE_BITS = 1 << 26  # a sieve takes an eighth of it in bytes, whatever the number of places


def _sieve_bit(file: Column, row: Column) -> Column:
    return F.pmod(F.xxhash64(file, row), F.lit(SIEVE_BITS)) + 1


def few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has so few rows that it may be sent to every executor."""
    return rows.limit(most + 1).count() <= most


def sieve(places: DataFrame, file: str = "file", row: str = "row") -> DataFrame:
    """A set of places as bits: at most ``SIEVE_BITS / 32768`` rows of 4 KB, so it may be sent to every executor."""
    bit = _sieve_bit(F.col(file), F.col(row))
    return places.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))


def sifted(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``located`` rows plus ``_met``: false only for places that the sieve does not hold. A place that it
    does not hold is met by chance, more often the fuller it is, so what is met still needs its exact join."""
    bit = _sieve_bit(F.col("_file"), F.col("_row"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("_bucket"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("_met"))


def worker_state(owner: str) -> dict:
    """What a Python worker keeps from one task to the next (caches of bounded size) for the operator ``owner``.

    What another operator kept goes, to the system: workers outlive a stage, and memory that no later stage reads is an executor's too.
    So an operator whose Python functions keep nothing calls this at their start as well."""
    name = "_stereoscope_llm_worker"
    if name not in sys.modules or sys.modules[name].owner != owner:
        before = sys.modules.pop(name, None)
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].owner, sys.modules[name].kept = owner, {}
        if before is not None:
            del before
            hand_back()
    return sys.modules[name].kept


def hand_back() -> None:
    """Free memory goes from this process to the system: caches refer to themselves, and allocators keep what is free."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches, rows: int = 256):
    """Arrow batches cut to a few rows each, so that what a task makes of whole texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_bytes(batches, column: str, size: int):
    """Arrow batches cut so that each has at most ``size`` bytes in a string column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), side="right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)
