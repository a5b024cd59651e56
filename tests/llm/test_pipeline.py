from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import decontaminate, mixing, secrets, simhash, toxicity


def test_each_stage_does_its_work(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / str(n)))
        kept.append(spark.read.parquet(str(tmp_path / str(n))))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[1] == {r.doc_id for r in toxicity.toxicity(kept[0], labels).where("predicted = 0").collect()}
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept[1]).collect()}
    assert ids[2] == set(groups.values())
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.find_leaks(kept[2], items).collect()}
    assert ids[4] == ids[3]
    assert secrets.scan_secrets(kept[4]).where("n_assign + n_access + n_hex > 0").count() == 0
    same = kept[3].join(secrets.scan_secrets(kept[3]).where("spans = ''").select("doc_id"), "doc_id").select(docs.columns)
    assert same.exceptAll(kept[4]).count() == 0
    mixed = {r.doc_id: r.taken for r in mixing.mix_documents(kept[4]).where("taken > 0").collect()}
    assert {r.doc_id: r.taken for r in kept[5].collect()} == mixed
    ran = corpus_pipeline.run(spark, sf_dir)
    assert ran.count() == kept[5].count() and ran.agg(F.sum("taken")).first()[0] == sum(mixed.values())
