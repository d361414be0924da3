"""Sinks: spec records with a creation stamp (A4), test-result records (A4), and the
CSV export of result pairs (A8). Writers are plain DataFrameWriter calls; the
frames they write are built by the functions here."""

from __future__ import annotations

import csv
import io
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stereoscope.operators.ordinals import ordinal_within
from stereoscope.session import materialize
from stereoscope.sources import files

CREATED_FORMAT = "dd/MM/yyyy HH:mm:ss"


def stamped(specs: DataFrame, created: str | None = None) -> DataFrame:
    now = F.date_format(F.current_timestamp(), CREATED_FORMAT)
    return specs.withColumn("created", now if created is None else F.lit(created))


def save_specs(specs: DataFrame, path: str, mode: str = "append") -> None:
    """A4: spec documents as JSON, partitioned by type (predefined / custom)."""
    stamped(specs).write.partitionBy("type").mode(mode).json(path)


def test_result_records(summary: DataFrame, names: DataFrame, source: str = "stereoscope", created: str | None = None) -> DataFrame:
    """A4: one record per (spec, model): spec name, source, tested model, creation stamp (now, or ``created``)."""
    return stamped(summary.join(names, "spec").select(
        F.col("bias_name").alias("name"), F.lit(source).alias("source"), "spec",
        F.struct(F.col("model").alias("tested_model")).alias("tested_results"),
        F.lit("custom").alias("type")), created)


def export_frame(display: DataFrame, names: DataFrame, order: list[Column | str] | None = None, by_model: bool = False) -> DataFrame:
    """Export rows with their number in the file, from 0, and the file name test_pairs_<bias name>.csv.

    ``order`` are the columns of ``display`` whose order the rows keep (by default the pair's id). Pairs scored by several models
    follow each other in one file; ``by_model`` gives each model its own, with the model's name before the ending."""
    d = display.join(names, "spec")
    model = F.concat(F.lit("_"), F.regexp_replace("model", "[^A-Za-z0-9._-]", "-")) if by_model else F.lit("")
    d = d.withColumn("file_name", F.concat(F.lit("test_pairs_"), F.col("bias_name"), model, F.lit(".csv")))
    d = ordinal_within(d, ["file_name"], [*(order or []), F.col("pair_id"), F.col("model")], out="_no")
    return d.select("file_name", (F.col("_no") - 1).cast("long").alias("row_id"), "Stereotyped", "Attribute", "Groups", "Sentence", "Alternative")


def _quoted(c: str) -> Column:
    """A CSV field: quoted where it holds a quote, a separator or a line break, quotes doubled; null is empty."""
    text = F.col(f"`{c}`").cast("string")
    return F.coalesce(F.when(text.rlike('[",\r\n]') | (text == ""), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def write_named_csv(frame: DataFrame, path: str, name_col: str, order: list[Column | str], columns: list[str], heads: list[str] | None = None) -> list[str]:
    """One CSV file per value of ``name_col`` under ``path``, with a header line and its rows in ``order``; returns the names.

    Rows are range-partitioned by name and order and written as part files, by as many tasks as there are
    partitions; a name's parts are then joined, in order, into a file that takes its place in one
    rename. The driver copies bytes by a fixed buffer; it holds no rows. A file that was there is replaced, others stay."""
    spark = frame.sparkSession
    path = path.rstrip("/")
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    line = F.concat_ws(",", *[_quoted(c) for c in columns])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(name_col), *[F.col(o) if isinstance(o, str) else o for o in order]]
    # kept before they are dealt: the bounds of the ranges are drawn from the rows first
    rows = materialize(frame).repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(F.col(name_col).alias("_file"), line.alias("value"))
    # part files are numbered by partition, a name's folder by the name: paths in order are rows in order
    rows.write.partitionBy("_file").option("lineSep", "\n").text(aside)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns if heads is None else heads)
    by_name: dict[str, list[str]] = {}
    for part in files.listed(spark, aside, "part-*"):
        by_name.setdefault(unquote(part.rsplit("/", 2)[1].split("=", 1)[1]), []).append(part)  # folders escape their value
    for name, parts in by_name.items():
        files.join_parts(spark, sorted(parts, key=lambda p: p.rsplit("/", 1)[1]), f"{path}/{name}", out.getvalue().encode("utf-8"))
    files.delete(spark, aside)
    return sorted(by_name)


def export_csv(frame: DataFrame, path: str) -> list[str]:
    """One file per ``file_name`` under ``path``, rows in ``row_id`` order, the row number first under an empty name."""
    shown = [c for c in frame.columns if c not in ("file_name", "row_id")]
    return write_named_csv(frame, path, "file_name", ["row_id"], ["row_id", *shown], ["", *shown])
