"""The pipeline against plain versions of its stages, each judged on its own input."""

import os
import re

import pytest
from pyspark.sql import functions as F

from hearthlake.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of each stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "CAST(NULL AS STRING) AS source", "n_chars")
    docs, folder, out = docs.unionByName(extra).unionByName(docs.limit(3)), tmp_path_factory.mktemp("p"), []
    docs.write.parquet(f"{folder}/in")
    docs = spark.read.parquet(f"{folder}/in")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((before, docs))
    return out


def test_columns_stay_the_same(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = stages[0]
    model = quality.train(before, quality.learnable(spark.read.parquet(f"{DATA}/labels.parquet")))
    scored = quality.score(before, model, ["doc_id", "text"]).where(F.col("score") >= model.cut)
    assert sorted(str(r.doc_id) for r in scored.collect()) == sorted(str(r.doc_id) for r in after.collect())
    assert 0 < after.count() < before.count()


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = (x.collect() for x in stages[1])

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    rows = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    want = sorted({find(i) for i in ids})
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)


def test_no_benchmark_window_stays(spark, stages):
    before, after = (x.collect() for x in stages[2])
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def split(t):
        return pattern.findall((t or "").translate(LOWER))

    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = split(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if not leaks(r.text))


def test_mix_repeats_documents(stages):
    before, after = (x.collect() for x in stages[3])
    from collections import Counter

    times = Counter(r.doc_id for r in after)
    assert set(times) <= {r.doc_id for r in before} and max(times.values()) <= 2
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in before}
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())


def test_shards_hold_every_row(stages):
    before, after = stages[4]
    rows = after.collect()
    assert len(rows) == before.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_run_gives_the_rows_of_its_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "size", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_stages_keep_columns_of_any_name_and_rows_of_repeated_ids(spark):
    """Columns named as those that the operators use, a dotted name, and ids that several texts share."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = {c: F.lit(k) for k, c in enumerate(["score", "_key", "key", "again", "_n", "n", "row", "size", "shard", "slot", "_h", "_text", "a.b", "text_crc32", "component_id"])}
    twice = docs.orderBy("doc_id").limit(2).withColumn("text", F.concat_ws(" ", F.lit("quite other words than those before"), F.reverse("text")))
    docs = docs.unionByName(twice).withColumns(extra)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.count()
        if stage is corpus_pipeline.sharding:
            assert rows == docs.count() and {"_key", "a.b", "size_", "shard_", "slot_", "text_crc32_"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and 0 < rows
            assert out.selectExpr("sum(score)", "sum(_key) / count(*)", "sum(`a.b`) / count(*)").first()[1:] == (1.0, 12.0)
        if stage is corpus_pipeline.near_duplicates:
            ids = [r.doc_id for r in twice.collect()]
            assert out.where(F.col("doc_id").isin(ids) & F.col("text").startswith("quite other words")).count() == 2, "a row is no copy because its id repeats"
    none = docs.limit(0)
    assert all(stage(spark, none, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
