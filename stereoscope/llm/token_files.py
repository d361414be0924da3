"""Token ids as Parquet files that can be read selectively.

Every document is one row: its id, how many ids it has, how many ids of its file stand before it, and the
ids as a list column. The ids are dictionary-coded (a vocabulary is small), the counts and offsets
delta-coded; row groups and pages have set sizes and the writer adds page indexes, so a reader of some
documents or of the metadata alone fetches only those pages. Files hold documents in ascending id order
and follow each other in that order.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, slices_of_bytes, text_or_empty, worker_state
from .units import MARK, BatchCache

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SLICE_BYTES = 3 << 20  # text that a task cuts at once: the more, the fewer units are looked up twice
MOST_FILES = 100_000  # the table of file totals is sent to every executor up to so many rows
ROW = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


class _Encoder:
    """The tokenizers library over text units; special tokens in a text are ordinary text."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the byte alphabet of this tokenizer kind
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        del self.alphabet[ord(MARK)]  # it parts pieces
        self.cache = BatchCache(self.unit, self.pieces, entries=700_000)

    def unit(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that are one piece of the pattern each and hold no ``MARK``."""
        tokenize = self.model.tokenize
        mapped = MARK.join(texts).encode("utf-8", "replace").decode("latin-1").translate(self.alphabet).split(MARK) if texts else []
        return [[t.id for t in tokenize(m)] for m in mapped]


def _encoder(model: bytes) -> _Encoder:
    state = worker_state("token files")
    key = ("tokenizer", hash(model))
    if key not in state:
        state[key] = _Encoder(model)
    return state[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, write the files under ``path``.

    Rows are range-partitioned by id and a hash of the text: one shuffle of the texts, and no partition depends
    on a key's frequency but for equal rows (null ids come first, and an id's rows follow each other by hash).
    The tokenizer file is read on the driver (its size does not grow with the data) and sent to workers.
    An empty table gives no rows.
    """
    with open(tokenizer_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, start = _encoder(model.value).cache, 0
        for batch in slices_of_bytes(batches, "text", SLICE_BYTES):
            ids, counts = cache.flat(batch.column("text"))
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(counts)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(start + ends - counts), pa.array(counts), lists],
                                             names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = ["doc_id", "_hash"]
    ordered = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash").withColumn("part", F.spark_partition_id())
    (ordered.mapInArrow(run, ROW).write
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
     .option("parquet.dictionary.page.size", 4 << 20).option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The files' rows with ``start``: how many ids stand before the document in all files.

    Offsets come from a read of two small columns: one total per file, summed over the files before.
    ``ids=False`` never opens the id column.
    """
    rows = spark.read.schema(ROW).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if len(rows.inputFiles()) <= MOST_FILES else base
    out = rows.join(base, "part").withColumn("start", F.col("base") + F.col("part_start"))
    return out.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def ids_crc32(df: DataFrame, ids_col: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace the id lists by the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    names = [c for c in df.columns if c != ids_col]
    schema = df.select(*names).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(ids_col)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8)
            ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))) * 4
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, out])

    return df.mapInArrow(run, schema)
