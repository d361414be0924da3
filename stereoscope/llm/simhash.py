"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at ``distance`` (2) or fewer differing bits. A fingerprint is cut into two segments, so
one of them differs by at most one bit. Each segment is indexed as it is and with one bit left out (a
wildcard): rows that agree on such a variant are joined and verified on the whole fingerprint. A variant
with one wildcard joins only rows that differ in the left-out bit, as equal segments meet once already.

A segment value that very many fingerprints share would make too many pairs. Its fingerprints, and those
one bit beside it, are linked in full instead: by variants of the whole fingerprint with two bits left out.
At most four fingerprints agree on one, all within two bits, so a star around the smallest loses no
component and the rows grow with the fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, located, on_files, slices, staged, text_or_empty, worker_state
from .components import components

HALF = 32
CROWD = 128  # fingerprints that share a segment value before they are linked by full variants
CHUNK = 1 << 15  # shingles whose bits are added up at once


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The bits set in over half of the shingles' XXH64 (seed 42), as an unsigned number; no words: 0."""
    import numpy as np
    import xxhash

    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        runs = zip(*[words[at + k : end + k] for k in range(shingle)]) if len(words) >= shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` plus ``out`` (long: the fingerprint's 64 bits); the text column is left out.

    A-Z are lower-cased; words are runs without white space (U+0020, U+0009..U+000D); a text with fewer
    words than a shingle is one shingle; no words (null, empty): 0. Whole texts are read, in chunks of
    shingles, so memory follows the text's own size.
    """
    names = [c for c in docs.columns if c not in (text_col, out)]
    text = fresh(docs, "_text")
    schema = docs.select(*names).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in slices(batches):
            fps = [fingerprint(t.lower().split(), shingle) for t in batch.column(text).to_pylist()]
            signed = pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), signed], names=[*names, out])

    return docs.select(*names, text_or_empty(text_col).cast("binary").alias(text)).mapInArrow(run, schema)


def _halves(fp: Column) -> list[Column]:
    return [F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(fp, s * HALF).bitwiseAND(F.lit((1 << HALF) - 1)).alias("value")) for s in (0, 1)]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``fps`` (distinct ``fp``) to edges (``a``, ``b``) whose components are those of all pairs at
    ``distance`` or fewer differing bits."""
    if distance != 2:
        raise ValueError("two segments with one wildcard, and two bits left out, serve a distance of 2")
    halves = fps.select("fp", F.explode(F.array(*_halves(F.col("fp")))).alias("h")).select("fp", "h.*")
    crowded = staged(halves.groupBy("segment", "value").count().filter(F.col("count") > CROWD).select("segment", "value"), "crowded")
    some = not crowded.isEmpty()
    calm = halves.join(crowded, ["segment", "value"], "left_anti") if some else halves

    # segment number and left-out bit (HALF: none) and the value without it, in one number
    def key(value: Column, bit: Column) -> Column:
        return F.call_function("shiftleft", (F.col("segment") * 64 + bit).cast("long"), F.lit(HALF)).bitwiseOR(value)

    every = F.sequence(F.lit(0), F.lit(HALF - 1))
    bits = F.transform(every, lambda i: F.struct(key(F.col("value").bitwiseAND(F.bitwise_not(_bit(i))), i).alias("key"),
                                                 (F.col("value").bitwiseAND(_bit(i)) != 0).alias("one")))
    variants = calm.select("fp", F.explode(bits).alias("v"))
    whole = calm.select("fp", key(F.col("value"), F.lit(HALF)).alias("key"))
    left = variants.filter("not v.one").select(F.col("fp").alias("a"), F.col("v.key").alias("key")).unionByName(whole.withColumnRenamed("fp", "a"))
    right = variants.filter("v.one").select(F.col("fp").alias("b"), F.col("v.key").alias("key")).unionByName(whole.withColumnRenamed("fp", "b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # without a wildcard both orders meet: one is enough
    once = (F.col("a") < F.col("b")) | (F.call_function("shiftrightunsigned", F.col("key"), F.lit(HALF)).bitwiseAND(F.lit(63)) != HALF)
    # Spark takes the exploded rows for as many as the fingerprints, and would broadcast them through the driver
    pairs = left.hint("merge").join(right.hint("merge"), "key").filter(near & once).select("a", "b")
    if not some:
        return pairs
    beside = F.transform(every, lambda i: F.col("value").bitwiseXOR(_bit(i)))
    # staged, so that the join knows the size of what was exploded
    reach = staged(crowded.select("segment", F.explode(F.concat(F.array("value"), beside)).alias("value")).distinct(), "reach")
    return pairs.unionByName(_stars(halves.join(reach, ["segment", "value"], "left_semi").select("fp").distinct()))


def _stars(fps: DataFrame) -> DataFrame:
    first = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    second = first.select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    keyed = second.select("fp", (F.col("i") * 64 + F.col("j")).cast("short").alias("bits"), F.col("fp").bitwiseAND(F.bitwise_not(_bit(F.col("i")).bitwiseOR(_bit(F.col("j"))))).alias("rest"))
    groups = keyed.groupBy("bits", "rest").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # four at most
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``keep`` columns, ``fp``, ``root`` (the component's smallest
    fingerprint) and ``component_id`` (the smallest id that links reach from the row, its own included).

    Texts without words have fingerprint 0 and are linked like any other. Null ids are not smaller than any
    id: a component of nulls alone has a null id. Rows with one id are separate rows. An empty table gives
    no rows.
    """
    own = staged(fingerprints(docs.select(id_col, *keep, text_col), shingle, text_col), "fingerprints")
    nodes = staged(own.groupBy("fp").agg(F.min(id_col).alias("low")), "nodes")
    root = components(links(nodes.select("fp"), distance))
    named = nodes.join(root, nodes.fp == root.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # files keep a repeated place's name once, rows each time: Spark sizes them too low for a broadcast
    return own.hint("merge").join(named.join(low, "root").select("fp", "root", "component_id"), "fp").select(id_col, *keep, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, null ids last; rows that share it go by place."""
    placed = located(on_files(docs))
    flat = placed.select(F.col(f"_doc.`{id_col}`").alias("id"), F.col(f"_doc.`{text_col}`").alias("text"), "_file", "_row")
    first = F.min(F.struct(F.col("id").isNull(), "id", "_file", "_row"))
    stay = near_groups(flat, shingle, distance, "id", "text", ("_file", "_row")).groupBy("root").agg(first.alias("s")).select("s._file", "s._row")
    return placed.join(stay, ["_file", "_row"], "left_semi").select("_doc.*")
