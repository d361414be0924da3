"""Bias specifications: two opposing lists of group terms and two of attribute terms.

A spec is normalised at once into the long table

    spec_terms(spec, axis, side, side_name, pos, term)

with ``axis`` in {'group', 'attribute'}, ``side`` the position of the list in
the spec (0 or 1; later lists are ignored) and ``pos`` the position of the term
in its list. Every other operator takes this table, so many specs run in one
job. Spec tables are small by construction (term lists); ``bounded`` checks it
before anything broadcasts them.
"""

from __future__ import annotations

import glob
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_DIR = os.path.join(os.path.dirname(__file__), "registry")

# Upper bounds on rows and bytes of any spec-derived table that gets a broadcast hint.
MAX_SPEC_TERMS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

TERM_LISTS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

SPEC_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("social_groups", TERM_LISTS),
    T.StructField("attributes", TERM_LISTS),
    T.StructField("templates", T.ArrayType(T.StringType())),
    T.StructField("sentences", T.ArrayType(T.StringType())),
    T.StructField("tested_results", T.StructType([T.StructField("tested_model", T.StringType())])),
])

SPEC_TERMS_SCHEMA = T.StructType([
    T.StructField("spec", T.StringType(), False),
    T.StructField("axis", T.StringType(), False),
    T.StructField("side", T.IntegerType(), False),
    T.StructField("side_name", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("term", T.StringType(), False),
])


@dataclass(frozen=True)
class BiasSpec:
    name: str
    group_1: tuple
    group_2: tuple
    attribute_1: tuple
    attribute_2: tuple
    group_names: tuple = ("group 1", "group 2")
    attribute_names: tuple = ("attribute 1", "attribute 2")
    source: str = ""
    url: str = ""
    type: str = "custom"
    templates: tuple = field(default_factory=tuple)

    def rows(self):
        for axis, names, lists in (("group", self.group_names, (self.group_1, self.group_2)),
                                   ("attribute", self.attribute_names, (self.attribute_1, self.attribute_2))):
            for side, (nm, terms) in enumerate(zip(names, lists)):
                for pos, t in enumerate(terms):
                    yield (self.name, axis, side, nm, pos, t)

    def lower(self) -> "BiasSpec":
        low = lambda xs: tuple(t.lower() for t in xs)
        return BiasSpec(self.name, low(self.group_1), low(self.group_2), low(self.attribute_1),
                        low(self.attribute_2), self.group_names, self.attribute_names, self.source,
                        self.url, self.type, self.templates)

    def to_json(self) -> dict:
        return {"name": self.name, "source": self.source, "url": self.url, "type": self.type,
                "social_groups": {self.group_names[0]: list(self.group_1), self.group_names[1]: list(self.group_2)},
                "attributes": {self.attribute_names[0]: list(self.attribute_1),
                               self.attribute_names[1]: list(self.attribute_2)},
                "templates": list(self.templates), "sentences": []}


def spec_terms(spark: SparkSession, specs) -> DataFrame:
    """Long term table from Python specs (a local relation: size known to the planner)."""
    if isinstance(specs, BiasSpec):
        specs = [specs]
    rows = [r for s in specs for r in s.rows()]
    if not rows:
        return spark.createDataFrame([], SPEC_TERMS_SCHEMA)
    # an inline VALUES table is a local relation: the planner knows its exact size
    values = ", ".join(f"({_lit(a)}, {_lit(b)}, {int(c)}, {_lit(d)}, {int(e)}, {_lit(f)})" for a, b, c, d, e, f in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(spec, axis, side, side_name, pos, term)")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPEC_TERMS_SCHEMA.fields])


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """A1: spec JSON documents (one per file, multi-line) with a fixed schema."""
    return spark.read.schema(SPEC_SCHEMA).option("multiLine", True).json(path)


def specs_to_terms(specs: DataFrame, spec_col: str = "name") -> DataFrame:
    """M1 -> long table. Map-entry position is the side; keys beyond the second are ignored."""
    parts = []
    for axis, col in (("group", "social_groups"), ("attribute", "attributes")):
        parts.append(
            specs.select(F.col(spec_col).alias("spec"), F.posexplode(F.map_entries(col)).alias("side", "e"))
            .where(F.col("side") < 2)
            .select("spec", F.lit(axis).alias("axis"), F.col("side").cast("int").alias("side"),
                    F.col("e.key").alias("side_name"), F.posexplode("e.value").alias("pos", "term"))
            .select("spec", "axis", "side", "side_name", F.col("pos").cast("int").alias("pos"), "term"))
    return parts[0].unionByName(parts[1])


def registry_specs(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """A1/A2/A5: the shipped registry; ``kind`` filters on the spec type (predefined / custom)."""
    df = read_specs(spark, os.path.join(REGISTRY_DIR, "*.json"))
    if kind is not None:
        df = df.where(F.col("type") == kind)
    return df


def registry_python(kind: str | None = None) -> list[dict]:
    out = []
    for p in sorted(glob.glob(os.path.join(REGISTRY_DIR, "*.json"))):
        with open(p) as fh:
            d = json.load(fh)
        if kind is None or d.get("type") == kind:
            out.append(d)
    return out


def spec_from_json(d: dict) -> BiasSpec:
    g = list(d["social_groups"].items())
    a = list(d["attributes"].items())
    return BiasSpec(d.get("tag") or d["name"], tuple(g[0][1]), tuple(g[1][1]), tuple(a[0][1]), tuple(a[1][1]),
                    (g[0][0], g[1][0]), (a[0][0], a[1][0]), d.get("source", ""), d.get("url", ""),
                    d.get("type", "custom"), tuple(d.get("templates", [])))


def spec_by_label(specs: DataFrame, labels: DataFrame) -> DataFrame:
    """A3: display label -> spec tag, as a join on ``label`` (the label table is tiny)."""
    return labels.join(bounded(specs.select("label", "tag", "name", "type")), "label", "left")


def _local_size_bound(df: DataFrame):
    """Bytes of a plan that only projects, filters or aggregates an in-memory local relation (a spec
    table): the optimizer's estimate is exact for the leaf and these steps do not exceed it. None otherwise."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        node = plan
        while True:
            kind = node.getClass().getSimpleName()
            if kind.startswith("LocalRelation"):
                return int(str(plan.stats().sizeInBytes()))
            if kind not in ("Project", "Filter", "Aggregate") or node.children().size() != 1:
                return None
            node = node.children().apply(0)
    except AttributeError:  # no JVM handle (Spark Connect): measure instead
        return None


def bounded(df: DataFrame, max_rows: int = MAX_SPEC_TERMS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only behind a check of its size: the exact size of spec-sized local
    relations, else its rows and their bytes as JSON. Beyond a bound the join is left to the planner
    (shuffle join, or AQE's broadcast from the measured shuffle size)."""
    size = _local_size_bound(df)
    if size is not None:
        return F.broadcast(df) if size <= max_bytes else df
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
