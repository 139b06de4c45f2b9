import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenledger.llm import queries, quality, toxicity
from greenledger.llm.labelled import fit_sample, held_out

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


def test_held_out_by_crc(frame):
    df = frame([(i,) for i in [0, 1, 7, 12345, -3, None]], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect()}
    assert got == {i: False if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


def test_fit_sample(frame):
    docs = frame([(i, f"t{i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(40)] + [(3, 0), (60, 1), (None, 1), (5, None)], "doc_id long, y int")
    got = fit_sample(docs, labels, "y", ~held_out("doc_id", 3, 1), 1000)
    want = [(i, f"t{i}", 0 if i == 3 else i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert rows_of(got, "doc_id", "text", "y") == sorted(want, key=repr)
    assert 0 < fit_sample(docs, labels, "y", ~held_out("doc_id", 3, 1), 7).count() <= 7


def test_trees_by_hand():
    """Flattened trees against walking them one row at a time."""
    r = np.random.default_rng(2)
    rows = r.normal(size=(600, len(quality.FEATURES)))
    labels = ((rows[:, 3] > 0.2) ^ (rows[:, 7] > 0)).astype(float)
    trees = quality.fit_trees(rows, labels)
    scores = trees.scores(rows)
    inner = trees.feature.shape[1]
    for row, score in zip(rows[:50], scores[:50]):
        total = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - inner]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((scores >= 0.5) == labels).mean() > 0.95


def test_trees_without_labels():
    none = quality.fit_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert none.scores(np.zeros((3, len(quality.FEATURES)))).tolist() == [0.5] * 3
    ones = quality.fit_trees(np.zeros((9, len(quality.FEATURES))), np.ones(9))
    assert ones.scores(np.zeros((1, len(quality.FEATURES))))[0] > 0.9


@pytest.mark.parametrize("text", [None, "", " ", "a", "x" * 100_000, "line\n" * 5000, "\U0001f600 é ß", "A B!! C##"])
def test_statistics_are_finite(text):
    found = quality.statistics_of(text)
    assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def area(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"))
    positive = labels == 1
    n1, n0 = positive.sum(), (~positive).sum()
    return (order[positive].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("query,label,least", [("op7_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, query, label, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    scores, truth = (np.array(x) for x in zip(*[(r["score"], labels[r["doc_id"]]) for r in tested]))
    assert area(scores, truth) >= least
    assert ((scores >= 0.5) == truth).mean() >= 0.95


def test_models_on_documents_of_all_kinds(docs, frame):
    labels = frame([(1, 0), (4, 1), (6, 1)], "doc_id long, quality int").selectExpr("*", "1 - quality toxic")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    scored = toxicity.score_toxicity(docs.drop("score"), labels)
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    empty = frame([], "doc_id long, text string")
    nothing = frame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(empty, nothing).collect() == []
    assert quality.score_quality(empty, quality.fit_quality(empty, nothing)).collect() == []
    assert {r["score"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}


def random_index(seed, n=1500, terms=40):
    r = np.random.default_rng(seed)
    vectors = []
    for _ in range(n):
        t = np.sort(r.choice(terms, r.integers(0, 5), replace=False))
        vectors.append((t, r.integers(1, 4, len(t)).astype(float)))
    idf = r.uniform(1, 6, terms)
    return vectors, idf, toxicity.build_index(np.arange(n) * 3, r.integers(0, 2, n).astype(float), vectors, idf)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_block_max_search_is_exact(seed):
    vectors, idf, index = random_index(seed)
    dense = np.zeros((len(vectors), len(idf)))
    for i, (t, c) in enumerate(vectors):
        if len(t):
            dense[i, t] = toxicity.unit(c, idf[t])
    ids = np.arange(len(vectors)) * 3
    for i in range(60):
        t, c = vectors[i]
        if not len(t):
            continue
        cosines = np.round(dense @ dense[i], 12)
        want = [j for j in np.lexsort((ids, -cosines)) if cosines[j] > 0][:10]
        slots, got = index.nearest(t, toxicity.unit(c, idf[t]), 10)
        assert np.allclose(got, cosines[want], atol=1e-11)
        # Rounding at the twelfth place may order equal cosines either way.
        if len(set(cosines[want].tolist())) == len(want):
            assert index.ids[slots].tolist() == ids[want].tolist()


def test_own_example_is_no_evidence():
    vectors, _, index = random_index(7)
    own = next(i for i, (t, _) in enumerate(vectors) if len(t) > 2)
    t, c = vectors[own]
    assert own * 3 not in index.score(t.tolist(), c.tolist(), own * 3, {})[1]
    assert own * 3 in index.score(t.tolist(), c.tolist(), None, {})[1]


def test_terms_of_a_small_sample(spark):
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert any(r["evidence"] for r in rows) and len({r["score"] for r in rows}) > 1


def test_every_term_beyond_chance_is_kept(frame):
    """Seven hundred words of which each stands in four of ten toxic texts and in no other."""
    words = ["".join(chr(97 + i // 26**p % 26) for p in range(3)) for i in range(700)]
    rows = [(" ".join(w for i, w in enumerate(words) if (d + i) % 10 < 4), 1) for d in range(10)] + [("clean", 0)] * 90
    terms = toxicity.pick_terms(frame(rows, "text string, y int"), "y", "text")
    assert set(words) <= set(terms)


def test_sweep_finds_what_blocks_find(monkeypatch):
    vectors, idf, index = random_index(5, 6000)
    for t, c in vectors[:80]:
        if len(t):
            swept = index.nearest(t, toxicity.unit(c, idf[t]), 10)
            with monkeypatch.context() as m:
                m.setattr(toxicity, "AHEAD", -1)
                by_block = index.nearest(t, toxicity.unit(c, idf[t]), 10)
            assert swept[0].tolist() == by_block[0].tolist() and np.allclose(swept[1], by_block[1], atol=1e-11)


def test_equal_texts_have_equal_scores_whatever_their_ids(spark):
    """The id is no input: training texts once more under other ids, labelled or not, and without one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    again = docs.where("doc_id < 300").selectExpr("doc_id + 1000000 doc_id", "text")
    nameless = docs.where("doc_id < 20").selectExpr("cast(null as bigint) doc_id", "text")
    scored = toxicity.score_toxicity(docs.unionByName(again).unionByName(nameless).withColumn("score", F.lit("clash")), labels, keep=("text",))
    spread = scored.groupBy("text").agg(F.count_distinct("score").alias("n"), F.count("*").alias("rows"))
    assert spread.where("n > 1").count() == 0 and spread.where("rows > 1").count() >= 200


def test_all_examples_of_a_text_are_left_out():
    """However many examples share the text, the nearest others are found."""
    vectors = [(np.array([0, 1]), np.ones(2))] * 60 + [(np.array([0, 2]), np.ones(2))] * 20
    texts = np.array([7] * 60 + list(range(100, 120)))
    index = toxicity.build_index(np.arange(80), np.array([1.0] * 60 + [0.0] * 20), vectors, np.ones(3), texts)
    score, evidence = index.score([0, 1], [1, 1], 7, {})
    assert evidence == list(range(60, 75)) and score < 0.5
    assert index.score([0, 1], [1, 1], 8, {})[1] == list(range(15))
