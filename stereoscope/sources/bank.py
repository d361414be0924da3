"""The sentence bank: saved generation records, stored as parquet partitioned by
``org_grp_term`` (one partition per generating group term), or as one CSV file per term.

Reads for a spec filter the partition column with the spec's group terms, so
the scan prunes partitions. An append writes the whole content of the terms it touches
as a new version and makes it current by one rename: until then, and if it is
killed, readers see the bank as it was. A term's rows are those of its last version,
or those under the bank's folder itself if no append touched it.
"""

from __future__ import annotations

import csv
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stereoscope.functions import patterns as P
from stereoscope.operators.ordinals import ordinal_within
from stereoscope.sources import files
from stereoscope.sources.specs import bounded

# FIXED VALUES: the stored records' and the older records' columns.
BANK_COLUMNS = ["sentence", "alt_sentence", "org_grp_term", "att_term", "template", "alt_template", "grp_term1",
                "grp_term2", "grp_refs", "label_1", "label_2", "bias_spec", "type", "gen_model"]
BANK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BANK_COLUMNS])
LEGACY_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                              for c in ("Group term", "Attribute term", "Test sentence")])


STORED_SCHEMA = T.StructType([*BANK_SCHEMA.fields, T.StructField("_at", T.LongType())])
VERSIONS = "_versions"


def _versions(spark: SparkSession, path: str) -> dict[str, str]:
    """Partition folder of each term's last version: term folder name -> path."""
    last: dict[str, str] = {}
    for version in folders_of_versions(spark, path):  # ascending
        for term in files.folders(spark, version):
            last[term.rsplit("/", 1)[1]] = term
    return last


def folders_of_versions(spark: SparkSession, path: str) -> list[str]:
    return [v for v in files.folders(spark, f"{path.rstrip('/')}/{VERSIONS}") if "/version=" in v]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All current rows, with ``_at`` (their place within the term; null for rows that no append touched)."""
    path = path.rstrip("/")
    try:
        rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        rows = spark.createDataFrame([], STORED_SCHEMA)
    last = _versions(spark, path)
    if not last:
        return rows
    # the folder names are the partition values, escaped as Spark escapes them
    newer = spark.read.schema(T.StructType([*STORED_SCHEMA.fields, T.StructField("version", T.LongType())])).option("basePath", f"{path}/{VERSIONS}").parquet(*last.values()).drop("version")
    touched = [r[0] for r in newer.select("org_grp_term").distinct().collect()]  # one per term folder
    return rows.where(~F.coalesce(F.col("org_grp_term").isin(touched), F.lit(False))).unionByName(newer)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).select(*BANK_COLUMNS)


def _plain(line: Column) -> Column:
    """Whether a line of a CSV file is sure to be whole records: every quote opens or closes a whole field or is doubled inside
    one, no quoted field goes on in the next line, and no character but the line feed ends a line."""
    bare = F.regexp_replace(line, '"[^"]*"', "\u0001")  # each quoted piece as one mark
    odd = bare.rlike('["\r]|[^,\u0001]\u0001|\u0001[^,\u0001]')
    return ~(odd | F.contains(line, F.lit("\u0000")) | line.rlike(r"^[\x00-\x20]+$"))


def _layouts(spark: SparkSession, path: str, terms: list[str] | None) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Header, and whether all lines are plain -> CSV files of that kind. One small row per file (a file per term) reaches the driver."""
    names = None if terms is None else {file_name(t) for t in terms}
    found = [f for f in files.listed(spark, path, "*.csv") if names is None or f.rsplit("/", 1)[1] in names]
    if not found:
        return {}
    lines = spark.read.option("lineSep", "\n").text(found).select("value", _file().alias("file"), F.monotonically_increasing_id().alias("at"))
    head = F.regexp_extract(F.min_by("value", "at"), "^[^\r]*", 0)
    heads = lines.groupBy("file").agg(head.alias("head"), F.min(_plain(F.col("value"))).alias("plain")).collect()
    out: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for r in sorted(heads):
        header = tuple(next(csv.reader([r.head.lstrip("\ufeff")])))
        out.setdefault((header, r.plain and '"' not in r.head), []).append(r.file)
    return out


def _file():
    """The row's file as a plain path (the hidden column escapes it as a URL)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_name(term: str) -> str:
    """The file of a term: blanks are dashes in it."""
    return term.replace(" ", "-") + ".csv"


def _read_csv(spark: SparkSession, path: str, columns: list[str], key: str, terms: list[str] | None) -> DataFrame:
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    out = spark.createDataFrame([], wanted)
    given = {file_name(t): t for t in terms or []}
    for (header, plain), paths in _layouts(spark, path, terms).items():
        if key not in header:
            continue
        # names that are no column of ours, or come twice, only hold their place
        unique = [c if c in columns and c not in header[:i] else f"_skip{i}" for i, c in enumerate(header)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in unique])
        # files whose records are lines are split among tasks
        lines = {"multiLine": False, "lineSep": "\n"} if plain else {"multiLine": True}
        rows = (spark.read.schema(schema).options(**lines).option("header", True).option("enforceSchema", True).option("quote", '"')
                # nothing between separators is null, a quoted nothing is an empty text
                .option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths))
        term = F.regexp_extract(_file(), r"([^/]*)\.csv$", 1)
        named = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.concat(term, F.lit(".csv"))] if given else F.lit(None)
        rows = rows.select(*[F.col(c) if c in unique else F.lit(None).cast("string").alias(c) for c in columns],
                           F.coalesce(named, F.translate(term, "-", " ")).alias("_term"))
        if "org_grp_term" in columns:
            rows = rows.withColumn("org_grp_term", F.coalesce("org_grp_term", "_term"))
        out = out.unionByName(rows.select(*columns))
    return out


def read_bank_csv(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """CSV import of per-term files, all columns strings.

    Every file's own header names its columns, in any order; absent ones are null, others are left out. Quotes
    are doubled inside quoted fields, which may hold separators and line breaks. Only a file in which a record goes
    over several lines, or quotes stand elsewhere, is one task; others are split. A row without ``org_grp_term`` has
    its file's term (of ``terms``, else the file's name with blanks for dashes). ``terms`` reads only their files; a
    missing file or folder gives no rows. Files of the
    older layout are read by ``read_legacy_csv``."""
    return _read_csv(spark, path, BANK_COLUMNS, "sentence", terms)


def read_legacy_csv(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """A6 for the older layout (``Group term``, ``Attribute term``, ``Test sentence``): input of ``retrieve_legacy``."""
    return _read_csv(spark, path, ["org_grp_term", "type", "gen_model", *LEGACY_SCHEMA.names], "Test sentence", terms)


def write_bank_csv(bank: DataFrame, path: str) -> None:
    """One CSV file per generating term, rows in stored order, as ``read_bank_csv`` reads them."""
    from stereoscope.sources.sinks import write_named_csv
    rows = bank.select(*BANK_COLUMNS, F.monotonically_increasing_id().alias("_at"))
    name = F.concat(F.translate("org_grp_term", " ", "-"), F.lit(".csv"))
    write_named_csv(rows.withColumn("_name", name), path, "_name", ["_at"], BANK_COLUMNS)


def write_bank(bank: DataFrame, path: str, mode: str = "append") -> None:
    # rebalanced by term: AQE splits a large term over tasks and joins small ones, so no task writes a whole hot term
    (bank.select(*BANK_COLUMNS).hint("rebalance", F.col("org_grp_term")).write
     .option("partitionOverwriteMode", "dynamic").partitionBy("org_grp_term").mode(mode).parquet(path))


def append_bank(spark: SparkSession, path: str, new: DataFrame, order_col: str | None = None) -> int:
    """Append ``new`` records to the stored bank, and return the version's number.

    Stored rows win over new ones, then the first in order: ``order_col``, or the rows' order in ``new``. The
    touched terms' whole content is written aside and becomes their version by one rename, so a killed
    append leaves the bank as it was. A version made by another writer meanwhile holds the number that
    this one wants: then nothing is changed and ``RuntimeError`` tells to append again."""
    from stereoscope.session import materialize
    path = path.rstrip("/")
    number = 1 + max([int(re.search(r"version=(\d+)$", v)[1]) for v in folders_of_versions(spark, path)], default=0)
    if order_col is None:
        new = new.withColumn("_at", F.monotonically_increasing_id())
    else:
        new = ordinal_within(new, ["org_grp_term"], [order_col], out="_at")
    new = materialize(new.select(*BANK_COLUMNS, "_at"))
    old = _stored(spark, path).withColumn("_at", F.coalesce("_at", F.monotonically_increasing_id()))
    # a small table: one row per term that is touched
    old = materialize(old.join(new.select("org_grp_term").distinct(), "org_grp_term", "left_semi").select(*BANK_COLUMNS, "_at"))
    merged = ordinal_within(append_dedupe(old, new, "_at"), ["org_grp_term"], ["_origin", "_at", "sentence"], out="_place")
    aside = f"{path}/{VERSIONS}/_writing-{uuid.uuid4().hex}"
    (merged.select(*BANK_COLUMNS, F.col("_place").alias("_at")).hint("rebalance", F.col("org_grp_term")).write.partitionBy("org_grp_term").parquet(aside))
    if not files.rename(spark, aside, f"{path}/{VERSIONS}/version={number:08d}"):
        files.delete(spark, aside)
        raise RuntimeError(f"another writer made version {number} of {path}: append again")
    return number


def bank_scan(bank: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """Rows of the bank for the spec's group terms (one read per term occurrence in
    the group lists: a term listed twice is read twice, as the measured tool does)."""
    g = spec_terms.where(F.col("axis") == "group")
    # partition pruning: the spec's group terms, a parameter, as a literal filter on the partition column
    bank = bank.where(F.col("org_grp_term").isin([r[0] for r in g.select("term").distinct().collect()]))
    g = bounded(g.select("spec", F.col("term").alias("org_grp_term"), F.col("side").alias("read_side"),
                         F.col("pos").alias("read_pos")))
    return bank.join(g, "org_grp_term")


def bank_filter(bank: DataFrame, paper_only: bool = False, models=P.BANK_GEN_MODELS) -> DataFrame:
    """Generator filter; rows without a type (legacy) are kept as they are."""
    keep = F.col("gen_model").isin(*models)
    if paper_only:
        keep = keep & (F.col("type") == "paper")
    return bank.where(F.col("type").isNull() | keep)


def att_variants(spec_terms: DataFrame) -> DataFrame:
    """Attribute spellings: as is, space -> dash, spaces removed (distinct)."""
    t = F.col("term")
    return (spec_terms.where(F.col("axis") == "attribute")
            .select("spec", F.explode(F.array_distinct(F.array(t, F.translate(t, " ", "-"),
                                                               F.regexp_replace(t, " ", "")))).alias("att_variant"))
            .distinct())


def retrieve_pairs(bank: DataFrame, spec_terms: DataFrame, paper_only: bool = False) -> DataFrame:
    """Test sentences of a spec: bank rows of every group term whose attribute is a
    spelling variant of a spec attribute and whose two group terms are both spec group terms."""
    rows = bank_filter(bank_scan(bank, spec_terms), paper_only)
    variants = bounded(att_variants(spec_terms)).withColumnRenamed("att_variant", "att_term")
    groups = bounded(spec_terms.where(F.col("axis") == "group").select("spec", F.col("term").alias("t")).distinct())
    rows = (rows.join(variants, ["spec", "att_term"], "left_semi")
            .join(groups.withColumnRenamed("t", "grp_term1"), ["spec", "grp_term1"], "left_semi")
            .join(groups.withColumnRenamed("t", "grp_term2"), ["spec", "grp_term2"], "left_semi"))
    return rows.select("spec", "read_side", "read_pos", "sentence", "alt_sentence",
                       F.col("grp_term1").alias("grp_term_1"), F.col("grp_term2").alias("grp_term_2"), "att_term")


def retrieve_legacy(legacy: DataFrame, spec_terms: DataFrame) -> DataFrame:
    """Legacy 3-column bank (paper rows only) for every group term of the spec, with
    '-' shown as a space. ``legacy``: (org_grp_term, type, gen_model, Group term, Attribute term, Test sentence)."""
    rows = bank_filter(bank_scan(legacy, spec_terms), paper_only=True).where(F.col("type").isNotNull())
    variants = bounded(att_variants(spec_terms)).withColumnRenamed("att_variant", "Attribute term")
    rows = rows.join(variants, ["spec", "Attribute term"], "left_semi")
    return rows.select("spec", F.col("Test sentence").alias("sentence"),
                       F.translate(F.col("Group term"), "-", " ").alias("grp_term"),
                       F.translate(F.col("Attribute term"), "-", " ").alias("att_term"))


def append_dedupe(old: DataFrame, new: DataFrame, order_col: str = "seq") -> DataFrame:
    """Per generating term, old rows then new rows, first occurrence of each sentence wins
    (old beats new; then the given order). Dedupe is per term, not global."""
    both = (old.withColumn("_origin", F.lit(0)).unionByName(new.withColumn("_origin", F.lit(1)),
                                                            allowMissingColumns=True))
    # first row per (term, sentence) as an aggregate: map-side combined, so a sentence
    # repeated in a third of all rows is reduced before the shuffle, not sorted in one task
    keys = ["org_grp_term", "sentence"]
    rest = [c for c in both.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("_origin", order_col))
    return both.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[F.col("_r." + c).alias(c) for c in rest])


def combine_sentences(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing ++ new (UNION ALL, no dedupe)."""
    return existing.unionByName(new)
