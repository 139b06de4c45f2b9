import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from greenledger.operators import models
from greenledger.operators.knn import Spans, cut_boxes, nearest_neighbours, predict

FEATURES = ["environmental", "social", "governance"]


def points(n, seed=5):
    """A third of the rows sit on one point, many others on a coarse grid, so ties are common."""
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, 1)) < 0.34, 50.0, r.integers(0, 40, (n, 3)) * 2.5)
    x[: n // 4] = r.normal(50, 20, (n // 4, 3))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["row_id"], pdf["total"], pdf["fold"] = r.permutation(n), r.normal(0, 1, n), np.arange(n) % 4
    return pdf


def brute(train, query, k, apart):
    out = set()
    t = train.sort_values("row_id")
    tx = t[FEATURES].to_numpy()
    for _, q in query.iterrows():
        d2 = np.zeros(len(t))
        for j, f in enumerate(FEATURES):
            d2 += (q[f] - tx[:, j]) * (q[f] - tx[:, j])
        if apart:
            d2 = np.where(t["fold"].to_numpy() == q["fold"], np.inf, d2)
        for i in np.argsort(d2, kind="stable")[:k]:
            if np.isfinite(d2[i]):
                out.add((int(q["row_id"]), int(t["row_id"].iloc[i]), float(d2[i])))
    return out


@pytest.mark.parametrize("box_rows,apart", [(10_000, None), (40, None), (40, "fold")])
def test_neighbours_equal_brute_force(spark, box_rows, apart):
    train, query = points(900), points(300, seed=6)
    got = nearest_neighbours(
        spark.createDataFrame(train), spark.createDataFrame(query), FEATURES, "row_id", 7, apart=apart,
        box_rows=box_rows, query_rows=25,
    )
    rows = {(r.query_key, r.neighbour_key, r.d2) for r in got.collect()}
    assert rows == brute(train, query, 7, apart)


def test_thin_boxes_visit_few_others():
    """Two thirds of the space hold no rows: a query there reaches the nearest boxes that have enough, not all."""
    r = np.random.default_rng(1)
    low = r.uniform(0, 1000, (512, 3))
    spans = Spans(low, low + r.uniform(0, 5, (512, 3)), np.where(np.arange(512) % 3 == 0, 4, 0))
    spans.low[spans.usable == 0], spans.high[spans.usable == 0] = np.inf, -np.inf
    queries = r.uniform(0, 1000, (200, 3))
    radius = spans.radius2(queries, 7)
    visited = (spans.near2(queries) <= radius[:, None]).sum(axis=1)
    assert np.isfinite(radius).all() and (visited >= 2).all() and visited.mean() < 12
    for q, r2 in zip(queries, radius):  # the bound holds the seven rows of any way to fill the boxes
        far = (np.maximum(abs(q - spans.low), abs(q - spans.high)) ** 2).sum(axis=1)
        assert spans.usable[far <= r2].sum() >= 7
    assert np.isinf(spans.radius2(queries[:3], 10_000)).all()


def test_hot_point_and_far_queries(spark):
    train, query = points(600), points(80, seed=9)
    query[FEATURES] = query[FEATURES] * 6 - 200  # most fall where there is nothing
    got = nearest_neighbours(
        spark.createDataFrame(train), spark.createDataFrame(query), FEATURES, "row_id", 7, box_rows=20, query_rows=25
    )
    assert {(r.query_key, r.neighbour_key, r.d2) for r in got.collect()} == brute(train, query, 7, None)


def test_fewer_rows_than_neighbours(spark):
    train, query = points(4), points(5, seed=7)
    got = nearest_neighbours(spark.createDataFrame(train), spark.createDataFrame(query), FEATURES, "row_id", 7)
    assert got.count() == 20


def test_zero_distance_takes_the_points_own_value(spark):
    near = spark.createDataFrame(
        [(1, 10, 5.0, 0.0), (1, 11, 7.0, 0.0), (1, 12, 99.0, 1.0), (2, 10, 5.0, 4.0), (2, 11, 8.0, 1.0)],
        "query_key bigint, neighbour_key bigint, target double, d2 double",
    )
    got = {r.query_key: r.predicted for r in predict(near).collect()}
    assert got == {1: 6.0, 2: pytest.approx((5 / 2 + 8 / 1) / (1 / 2 + 1))}


def test_boxes_cover_space():
    r = np.random.default_rng(0)
    boxes, x = cut_boxes(r.normal(size=(500, 3)), 6), r.normal(size=(2000, 3)) * 3
    assert (boxes.distance2(x)[np.arange(len(x)), boxes.of(x)] == 0).all()
    assert np.isin(cut_boxes(np.full((20, 3), 1.0), 3).of(np.full((5, 3), 1.0)), [0]).all()


def graded(spark, n=400):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame(r.uniform(0, 1000, (n, 3)), columns=FEATURES)
    pdf["total"] = pdf.sum(axis=1)
    pdf["row_id"], pdf["trade_name"], pdf["industry"] = np.arange(n), [f"c{i}" for i in range(n)], "s"
    return pdf, models.quartile_grades(spark.createDataFrame(pdf))


def test_quartile_grades(spark):
    pdf, df = graded(spark)
    want = pd.qcut(pdf["total"], 4, labels=list(models.GRADES)).astype(str)
    got = df.toPandas().set_index("row_id")["grade"].sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()
    with pytest.raises(Exception, match="unique"):
        models.quartile_grades(df.withColumn("total", F.lit(1.0))).collect()


def test_forest_beats_majority_and_scores_new_rows(spark):
    _, df = graded(spark)
    pairs = models.hold_out_classification(df, num_trees=20, max_depth=8)
    scores = models.classification_scores(pairs).first()
    assert scores.n == 80 and scores.accuracy > 0.5 and scores.macro_f1 > 0.5
    model = models.fit_forest(df, 10, 6)
    imp = models.importances(model, df).toPandas()
    assert imp["importance"].is_monotonic_increasing and imp["importance"].sum() == pytest.approx(1.0)
    new = models.default_row(df).withColumn("row_id", F.lit(1).cast("bigint"))
    row = models.score_rows(model, df, new).first()
    assert 0 < row.predicted_total < 3000 and row.predicted_grade in models.GRADES


def test_forests_are_fitted_in_parts_and_few_tasks(spark):
    """All trees are there, with seeds of their own; the tasks follow the rows, not the partitions they come in."""
    _, df = graded(spark, 120)
    many = df.repartition(40)
    one, other = models.fit_forests([many, many.where("row_id % 2 = 0")], num_trees=60, max_depth=4)
    assert [p.getNumTrees for p in one.parts] == [25, 25, 10] and one.num_trees == other.num_trees == 60
    assert len({p.trees[0].toDebugString.split("\n", 1)[1] for p in one.parts}) == 3
    assert models._training_rows(many).rdd.getNumPartitions() == 1
    got = models.classify(one, many)
    assert got.rdd.getNumPartitions() == 1 and {"row_id", "confidence", "predicted_grade"} <= set(got.columns)
    x = np.array([[r[f] for f in FEATURES] for r in many.collect()])
    votes = dict.fromkeys(map(tuple, x), 0)
    for part in one.parts:
        for r in part.transform(models.assembled(many)).collect():
            votes[tuple(r[f] for f in FEATURES)] += r[part.getRawPredictionCol()].toArray()
    for r in got.collect():
        share = votes[tuple(r[f] for f in FEATURES)] / 60
        assert r.predicted_grade == models.GRADES[share.argmax()] and r.confidence == pytest.approx(share.max())


def test_forests_keep_the_nodes_of_rows_and_their_trees(spark):
    """Rows do not walk the trees again at every level, and the trees are those of a fit where they do."""
    _, df = graded(spark, 200)
    rows = models._training_rows(df)
    (part,) = models.fit_forest(df, 5, 12).parts
    assert part.getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=5, maxDepth=12, seed=models.SEED, maxBins=64, weightCol="weight").fit(rows)
    assert [t.toDebugString.split("\n", 1)[1] for t in part.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]


def test_folds_hold_few_parts_of_their_forests(spark, monkeypatch):
    """The forests of all folds are there with all their trees, but a part goes once its rows have its votes."""
    _, df = graded(spark, 200)
    fit, transform, live, most, trees = RandomForestClassifier.fit, models.RandomForestClassificationModel.transform, [], [], []

    def seen(self, rows):
        model = fit(self, rows)
        live.append(weakref.ref(model))
        most.append(sum(ref() is not None for ref in live))
        trees.append(model.getNumTrees)
        return model

    def alone(self, rows):
        assert rows._jdf.queryExecution().logical().toString().count("UDF(") <= 1  # that of the assembled features, no other part
        return transform(self, rows)

    monkeypatch.setattr(RandomForestClassifier, "fit", seen)
    monkeypatch.setattr(models.RandomForestClassificationModel, "transform", alone)
    monkeypatch.setattr(models, "TREES_A_FIT", 4)
    monkeypatch.setattr(models, "NODES_A_FIT", 400, raising=False)
    monkeypatch.setattr(models, "HEAP_A_FIT", spark._jvm.Runtime.getRuntime().maxMemory() // 2, raising=False)
    got = models.fold_classification(df, num_trees=20, max_depth=6, n_folds=3).collect()
    assert sum(trees) == 3 * 20 and len(trees) > 3 * 2 and max(most) <= 2
    assert sorted(r.row_id for r in got) == list(range(200)) and {r.fold for r in got} == {0, 1, 2}
    assert {r.predicted_grade for r in got} <= set(models.GRADES)
    assert np.mean([r.grade == r.predicted_grade for r in got]) > 0.5


def test_parts_in_turn_vote_as_held_ones(spark, monkeypatch):
    """Keys that repeat or are missing keep their rows; with parts of the same size the shares are the same to the last bit."""
    _, df = graded(spark, 120)
    monkeypatch.setattr(models, "NODES_A_FIT", 1, raising=False)
    monkeypatch.setattr(models, "TREES_A_FIT", 1)
    odd = df.withColumn("row_id", F.when(F.col("row_id") % 3 > 0, F.col("row_id") % 7))
    (held,), (turn,) = (models.fit_forests([df], num_trees=3, max_depth=5, held=held) for held in (True, False))
    assert [p.getNumTrees for p in turn.parts] == [1, 1, 1] and turn.num_trees == held.num_trees == 3
    want, got = (sorted(map(repr, models.classify(model, odd).drop("_cuts").collect())) for model in (held, turn))
    assert len(got) == 120 and got == want


def test_classification_is_spread_over_tasks(spark):
    _, df = graded(spark, 200)
    model = models.fit_forest(df, 2, 3)
    many = df.crossJoin(spark.range(20))
    got = models.classify(model, many)
    assert got.count() == 4000 and got.rdd.getNumPartitions() == 4


def test_feature_table_makes_its_means_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def look(name):
        seen.add(1)
        return True

    wide = spark.range(50).select(
        F.format_string("c%03d", "id").alias("trade_name"), F.lit("s").alias("industry"),
        *[F.col("id").cast("double").alias(f) for f in FEATURES],
    )
    monkeypatch.setattr(models, "pillar_means", lambda base, *keys: wide.where(F.udf(look, "boolean")("trade_name")))
    got = models.feature_table(None)
    assert [r.row_id for r in got.orderBy("trade_name").collect()] == list(range(1, 51))
    assert seen.value == 50


def test_classification_scores_by_hand(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("BB", "A")], "grade string, predicted_grade string")
    got = models.classification_scores(pairs).first()
    # A 2*1/(2+1+1), B 2*1/(2+1), BB 0
    assert got.accuracy == 0.5 and got.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_regression_scores(spark):
    pairs = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "observed double, predicted double")
    got = models.regression_scores(pairs).first()
    assert got.rmse == pytest.approx(np.sqrt(1.25 / 3)) and got.r2 == pytest.approx(1 - 1.25 / (14 / 3))


def test_company_gate(spark):
    _, df = graded(spark)
    assert models.enough_companies(df) and not models.enough_companies(df.limit(39))
    few = df.limit(39)
    assert models.hold_out_regression(few).collect() == [] and models.fold_regression(few).collect() == []
    assert models.hold_out_classification(few).collect() == [] and models.fold_classification(few).collect() == []
