"""Sentence bank on disk: partition pruning on reads, dynamic overwrite on appends; sinks."""

import csv
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from stereoscope.operators import generation as GN
from stereoscope.plans import flagship as FL
from stereoscope.sources import bank as BK
from stereoscope.sources import sinks as SK


def _written_bank(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="stereoscope-bank-"), "bank")
    BK.write_bank(FL.derived_bank(spark, SF_SMALL), d)
    return d


def test_append_bank(spark):
    """Stored rows win, new sentences come in, only the touched terms' partitions are rewritten."""
    d = _written_bank(spark)
    before = BK.read_bank(spark, d).cache()
    n = {r.org_grp_term: r.n for r in before.groupBy("org_grp_term").agg(F.count_distinct("sentence").alias("n")).collect()}
    untouched = {t: sorted(os.listdir(f"{d}/org_grp_term={t}")) for t in n if t != "he"}
    some = before.where("org_grp_term = 'he'").limit(3)
    new = (some.withColumn("gen_model", F.lit("other"))
           .unionByName(some.limit(1).withColumn("sentence", F.lit("A wholly new sentence."))))
    BK.append_bank(spark, d, new)
    after = BK.read_bank(spark, d)
    assert after.where("org_grp_term = 'he'").count() == n["he"] + 1
    assert after.where("gen_model = 'other'").count() == after.where("sentence = 'A wholly new sentence.' and gen_model = 'other'").count()
    assert {t: sorted(os.listdir(f"{d}/org_grp_term={t}")) for t in untouched} == untouched


def test_bank_scan_prunes_partitions(spark):
    d = _written_bank(spark)
    df = BK.bank_scan(BK.read_bank(spark, d), FL.spec_table(spark, FL.retrieval_spec()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "org_grp_term" in plan and " IN (" in plan
    got = {r.org_grp_term for r in df.select("org_grp_term").distinct().collect()}
    assert got <= {"he", "it", "this", "those"}
    inmem = BK.bank_scan(FL.derived_bank(spark, SF_SMALL), FL.spec_table(spark, FL.retrieval_spec()))
    assert df.count() == inmem.count()


def test_append_rewrites_only_touched_terms(spark):
    d = _written_bank(spark)
    old = BK.read_bank(spark, d)
    before = {r.org_grp_term: r["count"] for r in old.groupBy("org_grp_term").count().collect()}
    new = FL.derived_bank(spark, SF_SMALL, corpus="conversations").where(F.col("org_grp_term") == "he")
    merged = BK.append_dedupe(old.where(F.col("org_grp_term") == "he").withColumn("seq", F.lit("")),
                              new.drop("pair_id").withColumn("seq", F.col("sentence")), order_col="seq")
    out = os.path.join(tempfile.mkdtemp(prefix="stereoscope-bank2-"), "bank")
    BK.write_bank(BK.read_bank(spark, d), out, mode="overwrite")
    BK.write_bank(merged.drop("seq", "_origin"), out, mode="overwrite")
    after = {r.org_grp_term: r["count"] for r in BK.read_bank(spark, out).groupBy("org_grp_term").count().collect()}
    assert {k: v for k, v in after.items() if k != "he"} == {k: v for k, v in before.items() if k != "he"}
    assert after["he"] >= len({r.sentence for r in old.where(F.col("org_grp_term") == "he").collect()})


def test_export_csv_and_records(spark):
    sp = FL.scored_pairs(spark, SF_SMALL)
    names = GN.spec_names(FL.spec_table(spark))
    from stereoscope.operators.display import display_pairs
    names = GN.spec_names(FL.spec_table(spark))
    frame = SK.export_frame(display_pairs(FL.scored_full(spark, SF_SMALL, scored=sp), keep=("doc_id", "sent_pos")), names, order=["doc_id", "sent_pos"])
    out = os.path.join(tempfile.mkdtemp(prefix="stereoscope-export-"), "csv")
    written = SK.export_csv(frame, out)
    assert len(written) == 1 and written[0].startswith("test_pairs_he_this__for_with_") and sorted(f for f in os.listdir(out) if f[0] not in "._") == written
    back = pd.read_csv(f"{out}/{written[0]}", index_col=0, keep_default_na=False)
    assert back.columns.tolist() == ["Stereotyped", "Attribute", "Groups", "Sentence", "Alternative"]
    want = frame.orderBy("row_id").toPandas()
    assert back.index.tolist() == list(range(len(want))) == want["row_id"].tolist()
    assert back.values.tolist() == want[back.columns].values.tolist()
    from stereoscope.operators.metrics import model_score
    rec = SK.test_result_records(model_score(sp), names).first()
    assert rec.tested_results.tested_model == "bigram-lm" and len(rec.created) == 19


def test_save_specs_partitioned_by_type(spark):
    from stereoscope.sources import specs as SP
    out = os.path.join(tempfile.mkdtemp(prefix="stereoscope-specs-"), "specs")
    SK.save_specs(SP.registry_specs(spark), out)
    assert sorted(p for p in os.listdir(out) if p.startswith("type=")) == ["type=custom", "type=predefined"]
    back = spark.read.json(out)
    custom = back.where(F.col("type") == "custom")
    plan = custom._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "custom" in plan
    assert custom.count() == 5                        # the four shipped custom specs and the fixture
    assert back.count() == 20
    assert all(len(r.created) == 19 for r in back.select("created").collect())


def test_bank_csv_import(spark):
    """A6 CSV import: per-term CSV files with a header, all columns strings."""
    out = os.path.join(tempfile.mkdtemp(prefix="stereoscope-bankcsv-"), "csv")
    bank = FL.derived_bank(spark, SF_SMALL).select(*BK.BANK_COLUMNS)
    bank.write.option("header", True).csv(out)
    back = BK.read_bank_csv(spark, out)
    assert back.columns == BK.BANK_COLUMNS
    assert back.count() == bank.count()
    assert back.where(F.col("type").isNull()).count() == bank.where(F.col("type").isNull()).count()


ODD_SENTENCES = ['She said "hello, you", then left.', "two\nlines, one\r\nfield", '"', "", "plain", " blanks around ", "back\\slash \\\" mixed", "é 日本 𝒳"]


def _odd_bank(spark):
    rows = [tuple([s, f"alt {s}", ("she", "old man")[i % 2], "a,b", None, f'"{i}"', "she", "he", "", "x", "y", "spec", ("tool", None)[i % 2], "gpt-4"]) for i, s in enumerate(ODD_SENTENCES * 2)]
    return rows, spark.createDataFrame(rows, BK.BANK_SCHEMA)


def _plain(rows):
    none = lambda v: v if v not in ("", None) else None  # noqa: E731  (an empty field is no value in either reader)
    return sorted([tuple(none(v) for v in r) for r in rows], key=repr)


def test_bank_csv_reads_what_pandas_writes(spark):
    """Files as the measured tool stores them: quotes, line breaks, reordered columns, the older layout, absent ones."""
    folder = tempfile.mkdtemp(prefix="stereoscope-csv-")
    rows, _ = _odd_bank(spark)
    df = pd.DataFrame(rows, columns=BK.BANK_COLUMNS)
    df[df.org_grp_term == "she"].to_csv(f"{folder}/she.csv", index=False)
    moved = df[df.org_grp_term == "old man"].drop(columns=["org_grp_term"])[BK.BANK_COLUMNS[::-1][:5] + BK.BANK_COLUMNS[:2] + BK.BANK_COLUMNS[3:9]]
    moved.to_csv(f"{folder}/old-man.csv")  # an index column, other order, no term column
    old = pd.DataFrame([["steel-worker", "he", 'so "it" is, or\nnot', "paper", "gpt-4"]], columns=["Attribute term", "Group term", "Test sentence", "type", "gen_model"])
    old.to_csv(f"{folder}/brother.csv", index=False)
    pd.DataFrame(columns=BK.BANK_COLUMNS).to_csv(f"{folder}/empty.csv", index=False)
    got = BK.read_bank_csv(spark, folder)
    assert got.columns == BK.BANK_COLUMNS
    assert _plain(got.collect()) == _plain(rows)
    one = BK.read_bank_csv(spark, folder, ["old man", "nobody"])
    assert _plain(one.collect()) == _plain([r for r in rows if r[2] == "old man"])
    legacy = BK.read_legacy_csv(spark, folder).collect()
    assert [tuple(r) for r in legacy] == [("brother", "paper", "gpt-4", "he", "steel-worker", 'so "it" is, or\nnot')]
    assert BK.read_bank_csv(spark, folder + "/none").count() == 0 and BK.read_bank_csv(spark, folder, []).count() == 0


def test_bank_csv_round_trip(spark):
    """Files written here are read by pandas and by the import, in the rows' order."""
    folder = tempfile.mkdtemp(prefix="stereoscope-csv-")
    rows, bank = _odd_bank(spark)
    BK.write_bank_csv(bank, folder)
    assert _plain(BK.read_bank_csv(spark, folder).collect()) == _plain(rows)
    for term, name in (("she", "she.csv"), ("old man", "old-man.csv")):
        with open(f"{folder}/{name}", newline="", encoding="utf-8") as fh:
            back = list(csv.reader(fh))
        assert back == [BK.BANK_COLUMNS] + [["" if v is None else v for v in r] for r in rows if r[2] == term]
    BK.write_bank_csv(bank.limit(1), folder)  # replaced whole, the other file stays
    assert len(pd.read_csv(f"{folder}/she.csv")) == 1 and len(pd.read_csv(f"{folder}/old-man.csv")) == len(rows) // 2


def _records(spark, rows):
    return spark.createDataFrame([(s, None, t, "a", None, None, t, None, None, None, None, None, None, m) for s, t, m in rows], BK.BANK_SCHEMA).coalesce(1)


def _content(spark, path):
    return sorted((r.sentence or "", r.org_grp_term, r.gen_model) for r in BK.read_bank(spark, path).collect())


def test_append_keeps_the_first_row(spark):
    """Of new rows with one sentence the first in input order stays, whatever the sentences are; then stored ones win."""
    path = os.path.join(tempfile.mkdtemp(prefix="stereoscope-bank-"), "bank")
    for first in ("m1", "m3"):
        models = ["m1", "m2", "m3"] if first == "m1" else ["m3", "m2", "m1"]
        p = f"{path}-{first}"
        assert BK.append_bank(spark, p, _records(spark, [("same", "he", m) for m in models] + [("other", "she", "m9"), (None, "he", "n1"), (None, "he", "n2")])) == 1
        assert _content(spark, p) == [("", "he", "n1"), ("other", "she", "m9"), ("same", "he", first)]
        assert BK.append_bank(spark, p, _records(spark, [("same", "he", "late"), ("new", "he", "m4"), ("same", "old man", "m5")])) == 2
        assert _content(spark, p) == [("", "he", "n1"), ("new", "he", "m4"), ("other", "she", "m9"), ("same", "he", first), ("same", "old man", "m5")]
    # an order column instead of the input order
    p = f"{path}-ordered"
    BK.append_bank(spark, p, _records(spark, [("same", "he", m) for m in ("m2", "m1", "m3")]), order_col="gen_model")
    assert _content(spark, p) == [("same", "he", "m1")]


def test_killed_or_second_append_leaves_the_bank(spark, monkeypatch):
    path = os.path.join(tempfile.mkdtemp(prefix="stereoscope-bank-"), "bank")
    BK.append_bank(spark, path, _records(spark, [("one", "he", "m1")]))
    before = _content(spark, path)
    new = _records(spark, [("two", "he", "m2"), ("three", "she", "m3")])
    with monkeypatch.context() as m:  # killed when all is written, before it is made current
        m.setattr(BK.files, "rename", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            BK.append_bank(spark, path, new)
    assert _content(spark, path) == before
    # another writer commits between this one's reading and its commit
    real, done = BK.files.rename, []

    def raced(spark_, source, target, **k):
        if not done:
            done.append(1)
            BK.append_bank(spark, path, _records(spark, [("theirs", "he", "m7")]))
        return real(spark_, source, target, **k)

    monkeypatch.setattr(BK.files, "rename", raced)
    with pytest.raises(RuntimeError):
        BK.append_bank(spark, path, new)
    assert _content(spark, path) == sorted(before + [("theirs", "he", "m7")])
    assert BK.append_bank(spark, path, new) == 3
    assert len(_content(spark, path)) == 4
