"""The pipeline on the small tables and on planted rows, stage by stage."""

import zlib

from cases import awkward, empty
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loantriad.llm.common import table
from loantriad.session import materialise
from test_texts import brute_near, brute_passages


def test_stages_follow_the_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "repeated_passages", "best_fit_packing"]


def test_every_stage_on_the_small_tables(spark, folder):
    docs = table(spark, folder, "documents")
    columns, steps = docs.columns, dict(cp.STAGES)
    first = materialise(steps["quality_rules"](spark, docs, folder), "q")
    assert first.columns == columns and 0 < first.count() < docs.count()
    second = materialise(steps["toxicity"](spark, first, folder), "t")
    assert second.columns == columns and second.count() <= first.count()
    third = materialise(steps["near_duplicates"](spark, second, folder), "n")
    expected = [d for d, _, _, kept in brute_near([(r.doc_id, r.text) for r in second.collect()], cp.NEAR_PERCENT) if kept]
    assert sorted(r.doc_id for r in third.collect()) == expected
    fourth = materialise(steps["repeated_passages"](spark, third, folder), "p")
    before, after = third.orderBy("doc_id").collect(), fourth.orderBy("doc_id").collect()
    assert fourth.columns == columns and [r.doc_id for r in before] == [r.doc_id for r in after]
    for (_, gone, _), x, y in zip(brute_passages([r.text for r in before], 35), before, after):
        assert len(y.text.encode().split()) == len(x.text.encode().split()) - gone and y.n_chars == len(y.text)
        assert gone or x.text == y.text
    packed = steps["best_fit_packing"](spark, fourth, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in after}
    bins = packed.groupBy("bin").agg(F.sum("length").alias("used"), F.max("capacity").alias("most"), F.min("capacity").alias("least"))
    assert bins.where("used > most or most <> least").count() == 0


def test_awkward_and_empty_tables(spark, folder):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, awkward(spark), folder)
        assert out.columns == awkward(spark).columns, name
        out.collect()
        assert stage(spark, empty(spark), folder).count() == 0, name


def test_rows_are_decided_by_themselves(spark, folder):
    """A rejected row takes no other row of its doc_id along, nulls included; of copies one stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = docs.join(table(spark, folder, "labels").where("quality = 1 and toxic = 0"), "doc_id").where("size(split(text, ' ')) between 80 and 400")
    a, b, c = [r.text for r in good.select("text").distinct().orderBy("text").limit(3).collect()]
    rows = [(9_000_001, a), (9_000_001, "junk"), (None, b), (None, "junk")]
    planted = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    kept = dict(cp.STAGES)["quality_rules"](spark, planted, folder).where("doc_id is null or doc_id = 9000001").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(9_000_001, a), (None, b)}
    copies = spark.createDataFrame([(7, a), (7, a), (7, b), (None, b), (None, c), (None, c), (5, a), (None, ""), (None, "")], docs.schema)
    left = dict(cp.STAGES)["near_duplicates"](spark, copies, folder).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(5, a), (7, b), (0, c), (0, ""), (0, "")])


def test_planted_rows(spark, folder):
    """Clean text stays, copies leave one, a shared passage goes."""
    docs = table(spark, folder, "documents")
    clean = docs.join(table(spark, folder, "labels").where("quality = 1 and toxic = 0"), "doc_id").where("size(split(text, ' ')) between 80 and 400")
    base = [r.text for r in clean.select("text").distinct().orderBy("text").limit(6).collect()]
    shared = " ".join(f"passage{i}" for i in range(60))
    words = [t.split() for t in base]
    rows = [(9_000_000 + i, t) for i, t in enumerate(base[:4])]
    near = words[0][:-1] + ["otherend"]
    rows += [(9_000_010, base[0]), (9_000_011, " ".join(near)), (9_000_012, base[4] + " " + shared), (9_000_013, base[5] + "\n" + shared)]
    planted = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in rows], docs.schema)
    steps = dict(cp.STAGES)
    kept = materialise(steps["quality_rules"](spark, planted.unionByName(docs), folder), "q").where("source = 'planted'")
    assert kept.count() == len(rows)
    left = {r.doc_id for r in steps["near_duplicates"](spark, planted, folder).collect()}
    assert left & {9_000_000, 9_000_010, 9_000_011} == {9_000_000} and {9_000_012, 9_000_013} <= left
    cut = {r.doc_id: r.text for r in steps["repeated_passages"](spark, planted, folder).collect()}
    assert "passage1" not in cut[9_000_012] and "passage1" not in cut[9_000_013] and cut[9_000_012].split()[:5] == base[4].split()[:5]
    assert zlib.crc32(cut[9_000_003].encode()) == zlib.crc32(base[3].encode())
