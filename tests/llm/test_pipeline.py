import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from greenledger.llm import packing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage kept, written and read again between stages."""
    out = [("documents", spark.read.parquet(f"{SF}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1][1], SF).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return out


def test_columns(stages):
    documents = stages[0][1]
    assert all(df.dtypes == documents.dtypes for _, df in stages[:-1])
    assert [n for n, _ in stages[1:]] == [n for n, _ in corpus_pipeline.STAGES]


def test_filters_only_filter(stages):
    for (_, before), (name, after) in zip(stages, stages[1:-1]):
        assert 0 < after.count() <= before.count()
        if name != "line_dedup":
            assert after.exceptAll(before).count() == 0
    labels = stages[0][1].sparkSession.read.parquet(f"{SF}/labels.parquet")
    good = stages[0][1].join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(stages[1][1], "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_lines_and_lengths(stages):
    before, after = stages[2][1], stages[3][1]
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    assert [r[0] for r in after.select("doc_id").orderBy("doc_id").collect()] == [
        r[0] for r in before.select("doc_id").orderBy("doc_id").collect()]


def test_one_document_of_each_group(stages):
    rows = stages[3][1].select("doc_id", "text").collect()
    prints = {r["doc_id"]: simhash.simhash(r["text"]) for r in rows}
    ids = sorted(prints)
    first = {}
    for i in ids:  # smallest id first, so a group's name is known when its later members come
        near = [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS]
        first[i] = near
    seen, keep = set(), []
    for i in ids:
        if i not in seen:
            keep.append(i)
            group = [i]
            for j in group:
                if j not in seen:
                    seen.add(j)
                    group.extend(first[j])
    assert sorted(r["doc_id"] for r in stages[4][1].select("doc_id").collect()) == keep


def test_packing_holds_every_document(stages):
    kept, packed = stages[4][1], stages[5][1]
    tokens = {r["doc_id"]: len(packing.token_ids(r["text"])) + 1 for r in kept.collect()}
    sums = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == tokens
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert sizes.where((F.col("n") != F.col("e")) | (F.col("n") > packing.CAPACITY)).count() == 0
    assert sizes.count() <= -(-sum(tokens.values()) // packing.CAPACITY) + 2


def test_run_is_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in contract.queries()}


def test_stages_on_documents_of_all_kinds(spark, docs, tmp_path):
    docs.sparkSession.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()} >= {6, 7}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
