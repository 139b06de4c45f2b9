"""Feature table, splits, regression, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators.ordering import hash_split
from ..session import checkpointed
from .domain import Domain
from .registry import query
from .statistics import PILLAR_MEANS, rounded

TREES, DEPTH = 300, 12

FEATURES = f"""features as (select *, environmental+social+governance total,
row_number() over (order by trade_name, industry) row_id from (select trade_name, industry, {PILLAR_MEANS}
from dashboard_base where industry is not null group by all having count(distinct pillar)=3))"""
GRADED = FEATURES + """,
edges as (select quantile_cont(total,0.25) q1, median(total) q2, quantile_cont(total,0.75) q3 from features),
graded as (select features.*, case when total<=q1 then 'B' when total<=q2 then 'BB' when total<=q3 then 'BBB' else 'A' end
grade from features, edges)"""
DRAW = "md5(concat_ws(':','42',trade_name,industry))"


def parts(source: str, over: str) -> str:
    """Row place and size of each stratum; the first ceil(n / 5) places are the test set."""
    return f""",
parts as (select *, row_number() over ({over} order by {DRAW}, trade_name, industry) <= (count(*) over ({over})+4)//5 is_test
from {source})"""


def fold_cte(source: str, over: str) -> str:
    return f""",
placed as (select *, row_number() over ({over} order by row_id)-1 place, count(*) over ({over}) n from {source}),
folded as (select *, cast(case when place < (n//5+1)*(n%5) then place//(n//5+1)
else n%5+(place-(n//5+1)*(n%5))//(n//5) end as int) fold from placed)"""


def knn_cte(where: str) -> str:
    return f""",
near as (select q.row_id, q.fold, q.total observed, t.total y, d2 from (
select q.row_id qid, t.row_id tid, (q.environmental-t.environmental)*(q.environmental-t.environmental)
+(q.social-t.social)*(q.social-t.social)+(q.governance-t.governance)*(q.governance-t.governance) d2,
row_number() over (partition by q.row_id order by d2, t.row_id) rk
from folded q join folded t on {where} qualify rk<=7) x
join folded q on q.row_id=qid join folded t on t.row_id=tid),
guess as (select row_id, fold, observed, case when min(d2)=0 then avg(y) filter (d2=0)
else sum(y/sqrt(case when d2=0 then 1 else d2 end))/sum(1/sqrt(case when d2=0 then 1 else d2 end)) end predicted
from near group by all)"""


SPLIT = FEATURES + parts("features", "")
HOLD_OUT = SPLIT + """,
folded as (select *, cast(is_test as int) fold from parts)""" + knn_cte("q.is_test and not t.is_test")
FOLDS = FEATURES + fold_cte("features", "") + knn_cte("q.fold<>t.fold")


def features(d: Domain):
    return models.feature_table(d.base)


@query("m1_feature_table", "select * from features", FEATURES)
def _(d: Domain):
    return features(d)


@query("m1_enough_companies", "select count(*)>=40 enough from features", FEATURES)
def _(d: Domain):
    wide = models.feature_table(d.base, numbered=False)
    return wide.agg((F.count(F.lit(1)) >= models.LEAST_COMPANIES).alias("enough"))


@query("m2_quartile_grades", "select trade_name, industry, grade from graded", GRADED)
def _(d: Domain):
    return models.quartile_grades(features(d)).select("trade_name", "industry", "grade")


@query("m3_hold_out", "select trade_name, industry, is_test from parts", SPLIT)
def _(d: Domain):
    return models.split(features(d)).select("trade_name", "industry", "is_test")


@query("m3_hash_split", "select trade_name, industry, md5(concat('42:',trade_name,':',industry))<'333333333333' is_test from features", FEATURES)
def _(d: Domain):
    wide = models.feature_table(d.base, numbered=False)
    return hash_split(wide, models.KEY, models.SEED).select("trade_name", "industry", "is_test")


@query("m4_stratified_hold_out", "select trade_name, industry, grade, is_test from parts", GRADED + parts("graded", "partition by grade"))
def _(d: Domain):
    return models.stratified_split(models.quartile_grades(features(d))).select("trade_name", "industry", "grade", "is_test")


@query("m5_m12_nearest_neighbour_regression", "select row_id, round(observed,6) observed, round(predicted,6) predicted from guess", HOLD_OUT)
def _(d: Domain):
    return rounded(models.hold_out_regression(features(d)).select("row_id", "observed", "predicted"), 6, "observed", "predicted")


@query(
    "m6_regression_scores",
    """select count(*) n, round(sqrt(avg((observed-predicted)*(observed-predicted))),6) rmse,
round(1-sum((observed-predicted)*(observed-predicted))/(var_pop(observed)*count(*)),6) r2 from guess""",
    HOLD_OUT,
)
def _(d: Domain):
    return rounded(models.regression_scores(models.hold_out_regression(features(d))), 6, "rmse", "r2")


@query("m7_folds", "select row_id, fold from folded", FEATURES + fold_cte("features", ""))
def _(d: Domain):
    return models.folds(features(d)).select("row_id", "fold")


@query(
    "m7_cross_validated_r2",
    """select count(*) folds, round(avg(r2),6) mean_r2 from (select fold,
1-sum((observed-predicted)*(observed-predicted))/(var_pop(observed)*count(*)) r2 from guess group by fold)""",
    FOLDS,
)
def _(d: Domain):
    return rounded(models.fold_r2(features(d)), 6, "mean_r2")


@query("m8_forest_hold_out", "select row_id, grade, true known_grade, true beats_majority from parts where is_test",
       GRADED + parts("graded", "partition by grade"))
def _(d: Domain):
    """The predicted grade itself depends on the drawn trees: it is held to the grades and to the largest class."""
    guess = models.hold_out_classification(models.quartile_grades(features(d)), TREES, DEPTH)
    guess = checkpointed(guess)
    majority = guess.groupBy("grade").count().agg(F.max("count") / F.sum("count")).scalar()
    hits = guess.agg(F.avg((F.col("grade") == F.col("predicted_grade")).cast("double"))).scalar()
    return guess.select("row_id", "grade", F.col("predicted_grade").isin(*models.GRADES).alias("known_grade"),
                        (hits > majority).alias("beats_majority"))


GUESSED = GRADED + """,
pairs as (select grade, case when row_id%7=0 then 'A' when row_id%5=0 then 'B' else grade end predicted_grade from graded),
sides as (select g, count(*) filter (grade=g and predicted_grade=g) tp, count(*) filter (grade=g)+count(*) filter (predicted_grade=g) seen
from pairs, (values ('A'),('B'),('BB'),('BBB')) t(g) group by g)"""


@query(
    "m9_classification_scores",
    "select (select count(*) from pairs) n, round((select count(*) filter (grade=predicted_grade)::double/count(*) from pairs),6) accuracy, round(avg(2.0::double*tp/seen),6) macro_f1 from sides where seen>0",
    GUESSED,
)
def _(d: Domain):
    graded = models.quartile_grades(features(d))
    guess = F.when(F.col("row_id") % 7 == 0, "A").when(F.col("row_id") % 5 == 0, "B").otherwise(F.col("grade"))
    scores = models.classification_scores(graded.withColumn("predicted_grade", guess))
    return rounded(scores, 6, "accuracy", "macro_f1")


@query("m10_stratified_folds", "select row_id, grade, fold from folded", GRADED + fold_cte("graded", "partition by grade"))
def _(d: Domain):
    return models.stratified_folds(models.quartile_grades(features(d))).select("row_id", "grade", "fold")


@query("m10_cross_validated_f1", "select 5::bigint folds, true above_half")
def _(d: Domain):
    scores = models.fold_f1(models.quartile_grades(features(d)), num_trees=TREES, max_depth=DEPTH)
    return scores.select("folds", (F.col("mean_macro_f1") > 0.5).alias("above_half"))


@query(
    "m10_fold_f1_of_given_predictions",
    """select fold, round(avg(2.0::double*tp/seen),6) macro_f1 from (select fold, g,
count(*) filter (grade=g and predicted_grade=g) tp, count(*) filter (grade=g)+count(*) filter (predicted_grade=g) seen
from (select fold, grade, case when row_id%7=0 then 'A' when row_id%5=0 then 'B' else grade end predicted_grade from folded),
(values ('A'),('B'),('BB'),('BBB')) t(g) group by fold, g) where seen>0 group by fold""",
    GRADED + fold_cte("graded", "partition by grade"),
)
def _(d: Domain):
    folds = models.stratified_folds(models.quartile_grades(features(d)))
    guess = F.when(F.col("row_id") % 7 == 0, "A").when(F.col("row_id") % 5 == 0, "B").otherwise(F.col("grade"))
    scores = models.classification_scores(folds.withColumn("predicted_grade", guess), "fold")
    return rounded(scores.select("fold", "macro_f1"), 6, "macro_f1")


@query("m11_t5_feature_importance", "select pillar, true used, 1.0::double total from category")
def _(d: Domain):
    graded = models.quartile_grades(features(d))
    found = models.importances(models.fit_forest(graded, TREES, DEPTH), graded)
    total = found.agg(F.round(F.sum("importance"), 9)).scalar()
    return found.select("pillar", (F.col("importance") > 0).alias("used"), total.alias("total"))


@query("m13_default_row", "select round(median(environmental),6) environmental, round(median(social),6) social, round(median(governance),6) governance from features", FEATURES)
def _(d: Domain):
    return rounded(models.default_row(features(d)), 6, *models.FEATURES)


SCALED = FEATURES + """,
scaled as (select row_id, environmental*1.01::double environmental, social*1.01::double social,
governance*1.01::double governance from features),
near as (select new.row_id, total y, (new.environmental-old.environmental)*(new.environmental-old.environmental)
+(new.social-old.social)*(new.social-old.social)+(new.governance-old.governance)*(new.governance-old.governance) d2
from scaled new join features old on true qualify row_number() over (partition by new.row_id order by d2, old.row_id)<=7),
guess as (select row_id, case when min(d2)=0 then avg(y) filter (d2=0)
else sum(y/sqrt(nullif(d2,0)))/sum(1/sqrt(nullif(d2,0))) end predicted from near group by row_id)"""


@query("m13_scored_rows", "select row_id, round(predicted,6) predicted_total, true known_grade from guess", SCALED)
def _(d: Domain):
    """Every company with values one percent higher, scored as new rows."""
    graded = models.quartile_grades(features(d))
    model = models.fit_forest(graded, TREES, DEPTH)
    new = graded.select("row_id", *[(F.col(f) * 1.01).alias(f) for f in models.FEATURES])
    scored = models.score_rows(model, graded, new)
    return rounded(scored, 6, "predicted_total").select(
        "row_id", "predicted_total", F.col("predicted_grade").isin(*models.GRADES).alias("known_grade")
    )
