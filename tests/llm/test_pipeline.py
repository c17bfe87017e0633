"""The stages, each against its operator on its own input."""

import corpus_pipeline
from strophekit.llm import decontam, quality, toxicity
from strophekit.llm.common import table, written
from tests.llm.helpers import frame, groups, odd_documents, shingles, similar_pairs
from tests.llm.test_ids import check_packing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "test-stage")
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.exceptAll(docs).count() == 0
        docs = out
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    labels = table(spark, SF, "labels")
    before, after = seen["quality"]
    good = quality.quality_scores(before, labels).filter("predicted = 1")
    assert {r["doc_id"] for r in good.collect()} == set(texts(after))
    before, after = seen["toxicity"]
    clean = toxicity.toxicity_scores(before, labels).filter("predicted = 0")
    assert {r["doc_id"] for r in clean.collect()} == set(texts(after))
    before, after = seen["near_duplicates"]
    sets = {d: shingles(t) for d, t in texts(before).items()}
    assert {d for d, g in groups(sorted(sets), similar_pairs(sets)).items() if d == g} == set(texts(after))
    before, after = seen["decontamination"]
    matcher = decontam.Matcher([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
    assert {d for d, t in texts(before).items() if not matcher.leaks(t)} == set(texts(after))
    before, after = seen["packing"]
    check_packing(after.collect(), list(texts(before).items()), 1023)


def test_odd_documents(spark, tmp_path):
    sf = str(tmp_path)
    frame(spark).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").limit(0).write.parquet(f"{sf}/benchmark.parquet")
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == frame(spark).columns
    assert docs.count() == len(odd_documents()) - 2  # two more rows of the text of document 1
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == 10
