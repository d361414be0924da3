"""The registered queries of the subpackage: thin wrappers that turn operators' results into the
contracts' columns, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, edits, exact_dedup, filter_audit, html_blocks, iblt, mixing, periodic_runs, quality_qda, quality_rules, sharding, simhash, token_files, toxicity
from .common import n_words, read, text_or_empty, work_dir
from .text_stats import words_of

SPACE_CLASS = r"[\x20\x09-\x0D]"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup.decisions(read(spark, sf_dir, "documents", "doc_id", "text"))
    id_ = lambda r: F.when(~F.col(f"{r}.no_id"), F.col(f"{r}.id"))
    return d.select(id_("rank").alias("doc_id"), id_("best").alias("keep_id"), F.col("n").alias("group_size"), "kept",
                    F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '{SPACE_CLASS}+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, distance=2)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(read(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mixing.copies(read(spark, sf_dir, "documents", "doc_id", "text", "source"), share=1.5, weights=(3, 1, 2))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, coalesce(least(cap, v.level * weight), cap) AS target,
         ('0x' || substr(md5('7:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM w, v),
n AS (
  SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(start + k * rate) - floor(start + (k - 1) * rate)))::BIGINT AS taken FROM n
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    token_files.write_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.ids_crc32(token_files.read_tokens(spark, path))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.encoded(read(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded_out="decoded", keep_text=False))


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns from ``ids`` and ``decoded``."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shards(read(spark, sf_dir, "documents", "doc_id", "text"), 16)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP9_SQL = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS c FROM range(256) r(i))),
b AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, tab),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, ((2 * before + size) * 16 // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
       NULL::INTEGER AS grown_shard FROM s
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.scored(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    words = F.element_at(F.transform(F.array(words_of(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), 1)
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("words", words)
    conditions = {"A": F.col("words.n") < 200, "B": 100 * F.col("words.distinct") < 50 * F.col("words.n"),
                  "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text), "D": text.rlike("[#$%&*|]")}
    return filter_audit.audit(docs, read(spark, sf_dir, "labels"), conditions, repeats="E")


OP11_SQL = r"""
WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
d AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < t.doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END,
                      CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT concat(f1.f, f2.f, f3.f, f4.f, f5.f) AS filter_order FROM f f1, f f2, f f3, f f4, f f5
  WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, range(1, 6) r(step)),
g AS (
  SELECT *, contains(fails, f) AS failing, earlier <> '' AND translate(fails, earlier, '') <> fails AS gone FROM s, m),
r AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["k1", "k2"]
    docs = iblt.bucketed(edits.versions(read(spark, sf_dir, "documents", "doc_id", "text")), key, "versions")
    found = iblt.differences(docs, key, "own", {"near_edited": "edited", "near_next": "next"}, listed=False)
    near = found.groupBy(*key).agg(*[F.max(F.when(F.col("pair") == p, F.col("n_found"))).alias(p) for p in ("near_edited", "near_next")])
    texts = iblt.fingerprint(docs, key, {"fingerprint": "own", "edited_fingerprint": "edited"})
    like = lambda p, other: iblt.likeness(F.col(p), F.col("own"), F.col(other)).alias(p)
    return docs.join(texts, key).join(near, key).select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                        like("near_edited", "edited"), like("near_next", "next"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, words, n = F.floor(h / 10), words_of(text_or_empty("text")), n_words(F.col("text"))
    # the contract's planted repeats: words from a on go round a period p
    planted = d.select("doc_id", "text", (h % 10 == 0).alias("_some"), g.alias("_g")).withColumn("_n", F.when(F.col("_some"), n).otherwise(F.lit(0)))
    planted = planted.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    round_ = lambda w: F.transform(w, lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get(w, (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    again = F.element_at(F.transform(F.array(words), lambda w: F.array_join(round_(w), " ")), 1)
    docs = planted.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))
    r = periodic_runs.with_runs(docs, least=12).withColumn("best", F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("l"), (-x["start"]).alias("s"), (-x["period"]).alias("p")))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    length, period = F.col("best.l"), -F.col("best.p")
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
                    F.call_function("div", 1000 * length, period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_html_extraction, op4_mixing, op5_token_files, op6_toxicity, op7_quality_rules, op8_bpe,
                                   op9_sharding, op10_quality_classifier, op11_filter_audit, op12_document_fingerprints, op13_periodic_runs)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op4_mixing": OP4_SQL, "op9_sharding": OP9_SQL, "op11_filter_audit": OP11_SQL}
