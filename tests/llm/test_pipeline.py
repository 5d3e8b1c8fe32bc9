"""The corpus pipeline, stage by stage on what each has before it."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_matching_operators import groups_by_force


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns, name
        kept[name] = (docs, out)
        docs = out
    before, after = kept["language ID"]
    assert after.count() >= 0.95 * before.count()
    before, after = kept["near-duplicates"]
    want = groups_by_force({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if i == c}
    before, after = kept["benchmark decontamination"]
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    items = []
    for r in spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null").collect():
        w = words(r["text"])
        n = min(5, len(w))
        if n:
            items.append((n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    sizes = {n for n, _ in items}
    clean = set()
    for r in before.where("text is not null").collect():
        w = words(r["text"])
        have = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in sizes}
        if not any(len(have[n] & item) >= 0.8 * len(item) - 1e-9 for n, item in items):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == clean and len(clean) < before.count()
    before, after = kept["secret masking"]
    assert before.count() == after.count() and after.where(F.col("text").rlike("AKIA[0-9A-Z]{16}")).count() == 0
    assert after.where(F.length("text") != F.col("n_chars")).count() <= before.where(F.length("text") != F.col("n_chars")).count()
    before, after = kept["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded_length").alias("m")).where("n <> m").count() == 0


def test_stages_on_awkward_rows(spark):
    # Null ids and texts, repeated rows, planted benchmark passages and secrets; then empty tables.
    d = "/root/testdata/sf0.001"
    item = next(r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if len(r["text"].split()) >= 8)
    clean = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en' and length(text) between 300 and 900").orderBy("doc_id").limit(6).collect()]
    rows = [(1, clean[0]), (1, clean[0]), (2, clean[1]), (3, clean[0]), (4, None), (5, ""), (None, clean[2]), (6, f"{clean[3]} {item} {clean[4]}"), (7, f"{clean[5]} password = hG7tR2xQ9vLmZ4"), (7, clean[1] + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    everything = spark.read.parquet(f"{d}/documents.parquet").select(*docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language ID"](spark, docs.unionByName(everything.where("doc_id > 100")), d).where("doc_id <= 7 or doc_id is null")
    assert found(named) == sorted([(i, t) for i, t in rows if t], key=str)
    once = stages["near-duplicates"](spark, docs, d)
    assert [i for i, _ in found(once)].count(1) == 1 and 3 not in [i for i, _ in found(once)] and (None, clean[2]) in found(once) and (4, None) in found(once) and (5, "") in found(once)
    left = stages["benchmark decontamination"](spark, docs, d)
    assert found(left) == sorted([x for x in rows if x[0] != 6], key=str)
    masked = stages["secret masking"](spark, docs, d)
    assert sorted(i for i, t in found(masked) if t and "hG7tR2xQ9vLmZ4" in t) == [] and len(found(masked)) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_run(spark):
    d = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, d).count() > 0
