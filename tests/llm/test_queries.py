"""Each registered query with SQL against DuckDB, the pipeline against its plain restatement, and the
columns that the contracts name."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers as P
import pytest

import corpus_pipeline
from stereoscope.llm import queries, toxicity

from .conftest import SF
from .test_dedup import brute_components, brute_fingerprint, normal

COLUMNS = {
    "op1_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_html_extraction": ["page_id", "url", "text", "n_chars"], "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op11_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op12_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda df: df[names].astype(object).where(df[names].notna(), None).sort_values([c for c in ("doc_id", "part", "filter_order", "step") if c in names]).values.tolist()
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(df.columns)


def test_held_out_folds(spark):
    for name, n, held in (("op6_toxicity", 3, 1), ("op10_quality_classifier", 5, 0)):
        for r in queries.QUERIES[name](spark, SF).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == held)


def test_pipeline_against_its_restatement(spark, small, labels):
    """Every stage's decisions take effect on what the stage before kept."""
    import base64

    import tiktoken
    df, rows = small
    text, source = dict(rows), {r.doc_id: r.source for r in df.collect()}
    kept = {r["doc_id"] for r in toxicity.scored(df, labels).filter("predicted = 0").collect()}
    best = {}
    for i in kept:
        k = normal(text[i])
        best[k] = min(best.get(k, (0, float("inf"))), (-len(text[i]), i))
    kept = {i for _, i in best.values()}
    fps = {i: brute_fingerprint(text[i]) for i in kept}
    root = brute_components(set(fps.values()))
    first = {}
    for i, f in fps.items():
        first[root[f]] = min(first.get(root[f], i), i)
    kept = set(first.values())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in kept}
    out = corpus_pipeline.run(spark, SF).collect()
    copies = {}
    for r in out:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= kept and max(copies.values()) <= 2
    from .test_mix_shards import brute_targets
    sizes = {}
    for i in kept:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    for s, t in brute_targets(sizes, 1.5, (3, 1, 2)).items():
        mine = [i for i in kept if source[i] == s]
        assert abs(sum(copies.get(i, 0) * size[i] for i in mine) - t) <= max(size[i] for i in mine) + 1
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        ids = plain.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
            assert (out.count() == 0) == (docs is none)
