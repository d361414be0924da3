import base64
import random
import zlib
from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest

from stereoscope.llm import bpe, token_files
from stereoscope.llm.common import slices_of_bytes, work_dir, worker_state
from stereoscope.llm.units import BatchCache, units

from .conftest import ODD

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("byte_bpe_50k.json")
HARD = ["a  b", "\n \n b", "don't  x  y \x1c z", "  ", "", " a", "a ", "l'été \t x\r\n", "日本語 テスト  𝒳 é́ 　x", " " * 50 + "x", "a" * 3000, "<|endoftext|> x",
        "a  b   c", "word. word, word! WORD's '\x85 x"]


def texts(small):
    rng = random.Random(3)
    made = ["".join(rng.choice(" ab.,!\n\tз日  é1'\x85st") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    return HARD + made + [t for _, t in small[1]] + [r[1] or "" for r in ODD]


def test_units_join_to_the_text(small):
    assert all("".join(units(t)) == t for t in texts(small))


@pytest.fixture(scope="module")
def byte_bpe():
    with open(RANKS, "rb") as f:
        return bpe.ByteBPE(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_merges(small, byte_bpe, plain):
    for t in texts(small):
        assert list(byte_bpe.encode(t)) == plain.encode_ordinary(t), t[:60]
        assert byte_bpe.decode(byte_bpe.encode(t)) == t.encode()


def test_small_caches_change_nothing(small, byte_bpe, plain, monkeypatch):
    monkeypatch.setattr(byte_bpe.cache, "entries", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 7)
    for t in texts(small)[:300]:
        assert list(byte_bpe.encode(t)) == plain.encode_ordinary(t)


def test_columns(spark, odd, none, clashing, plain):
    coded = bpe.decoded(bpe.encoded(odd, RANKS, P.PATTERN), RANKS)
    for r in coded.collect():
        assert r["ids"] == plain.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encoded(none, RANKS, P.PATTERN).count() == 0
    out = bpe.encoded(clashing, RANKS, P.PATTERN)
    assert sorted(out.columns) == sorted(clashing.columns) and out.first()["_text"] == "mine"


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    return t


def test_library_ids_by_units(small):
    tok = library()
    with open(MODEL, "rb") as f:
        own = token_files._Encoder(f.read())
    for t in texts(small):
        assert list(array("I", own.cache.text(t))) == tok.encode(t, add_special_tokens=False).ids, t[:60]


def check_files(spark, df, rows):
    path = work_dir(spark, "t-tokens")
    token_files.write_tokens(df, path, MODEL, 2)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    tok = library()
    want = sorted(([i, tok.encode(t or "", add_special_tokens=False).ids + [2]] for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), ids) for i, ids in want)
    crc = {(r["start"], r["ids_crc32"]) for r in token_files.ids_crc32(token_files.read_tokens(spark, path)).collect()}
    assert crc == {(r["start"], zlib.crc32(array("I", r["ids"]).tobytes())) for r in got}
    meta = token_files.read_tokens(spark, path, ids=False)
    assert meta.count() == len(rows) and "ids" not in meta.columns
    return path


def test_files(spark, small, odd, none):
    path = check_files(spark, *small)
    check_files(spark, odd, [(r[0], r[1]) for r in ODD])
    check_files(spark, none, [])
    # encodings and page indexes as asked for
    import glob

    import pyarrow.parquet as pq
    file = max(glob.glob(path.removeprefix("file:") + "/*.parquet"), key=lambda f: pq.read_metadata(f).num_rows)
    group = pq.read_metadata(file).row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for p, c in columns.items() if p.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings)
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert columns["n_tokens"].has_offset_index and columns["n_tokens"].has_column_index


def test_rows_of_one_id_go_to_many_files(spark):
    rows = spark.range(4000).selectExpr("if(id < 3000, if(id < 1500, null, 7), id) as doc_id", "concat('text ', id) as text")
    path, name = work_dir(spark, "test-hot"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        token_files.write_tokens(rows, path, MODEL, None)
    finally:
        spark.conf.unset(name)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert len(ids) == 4000 and ids == sorted(ids)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    per_file = spark.read.parquet(path).groupBy("part").count().toPandas()["count"]
    assert per_file.max() < 1000


def test_units_that_differ_in_marks_cost_one_piece(small):
    """A word with marks behind it is not encoded again, and a table that is full starts anew with the same ids."""
    tok = library()
    with open(MODEL, "rb") as f:
        own = token_files._Encoder(f.read())
    asked = []
    cache = BatchCache(own.unit, lambda texts: asked.extend(texts) or own.pieces(texts), entries=40)
    for t in ["one cat, one cat. one (cat) déjà déjà, vu!\nOne, 12,5 don't cat; x\x00y", "", "a cat sat\ton the  mat ", *texts(small)[:60]]:
        want = tok.encode(t, add_special_tokens=False).ids
        for n in (1, 2):
            ids, counts = cache.flat(pa.array([t] * n))
            assert ids.tolist() == want * n and counts.tolist() == [len(want)] * n
    asked.clear()
    cache = BatchCache(own.unit, lambda texts: asked.extend(texts) or own.pieces(texts))
    cache.flat(pa.array(["a cat, a cat. a cat; a cat", "a cat! the cat"]))
    assert sorted(asked) == [" a", " cat", " the", "a"]


def test_slices_of_bytes():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "text": ["aaaa", None, "é", "b" * 50, "", "cc"]})
    got = [b.column("k").to_pylist() for b in slices_of_bytes([batch, batch.slice(6)], "text", 6)]
    assert got == [[0, 1, 2], [3], [4, 5]]


def test_a_worker_keeps_one_operators_caches():
    import weakref

    class Cache:
        pass

    state = worker_state("one")
    state["cache"] = Cache()
    gone = weakref.ref(state["cache"])
    del state
    assert worker_state("one")["cache"] is gone()
    assert worker_state("two") == {} and gone() is None


def test_caches_that_refer_to_themselves_go_too(byte_bpe):
    import gc
    import weakref

    class Kept:
        pass

    kept = Kept()
    kept.own = kept  # as a cache that holds its encoder's methods
    gone = weakref.ref(kept)
    gc.disable()
    try:
        worker_state("one")["cache"] = kept
        del kept
        worker_state("two")
        assert gone() is None
    finally:
        gc.enable()


def test_what_a_worker_keeps_of_units_is_bounded(byte_bpe):
    assert byte_bpe.cache.entries == bpe.UNITS_KEPT <= 100_000
