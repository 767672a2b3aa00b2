"""The pipeline's stages, one after another, over documents with a benchmark beside them."""

import corpus_pipeline
from fleetshape.llm import decontaminate, mixing, quality, simhash


def test_stages_take_effect(spark, docs, texts, tmp_path):
    path = str(tmp_path)
    docs.drop("shard").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[9].split()[:14]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name != "sharding":
            assert out.columns == now.columns
        out.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        if name == "quality_rules":
            assert 0 < now.count() < docs.count() and quality.apply_policy(quality.measure(now)).where("not kept").count() == 0
        if name == "near_dedup":
            assert simhash.near_duplicates(now).select("component_id").distinct().count() == now.count()
        if name == "decontamination":
            assert decontaminate.contamination(now, bench).where("n_hit > 0").count() == 0
        if name == "source_mixing":
            before = spark.read.parquet(f"{path}/decontamination")
            assert mixing.taken(before).selectExpr("sum(taken) t").first()[0] == now.select(mixing.word_count(now["text"]).alias("n")).groupBy().sum().first()[0]
    assert now.count() > 0 and {"shard", "slot", "text"} <= set(now.columns)
    assert corpus_pipeline.run(spark, path).count() == now.count()
