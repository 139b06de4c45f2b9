"""Feature table, grades, splits, regression and classification with their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from threading import Semaphore

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import PILLARS
from ..session import checkpointed
from .dashboard import Dashboard
from .knn import nearest_neighbours, predict
from .ordering import contiguous_folds, dense_ids, exact_percentiles, hold_out
from .profile import pillar_means
from .rows import side_by_side

FEATURES = tuple(p.lower() for p in PILLARS)
KEY = ("trade_name", "industry")
GRADES = ("B", "BB", "BBB", "A")
LEAST_COMPANIES = 40
SEED = 42
#: Trees that are fitted by one run of Spark's forest, and such runs at a time; rows of one task, about, in training and in
#: classification, where a task may be smaller while cores are free. Of parts that are not held: nodes of one, about, and
#: bytes of the driver's heap for each that is there at a time.
TREES_A_FIT = 25
FITS_A_CORE = 2
NODES_A_FIT = 60_000
HEAP_A_FIT = 300_000_000
TRAINED_A_TASK = 100_000
TRAINED_AT_LEAST = 20_000
CLASSIFIED_A_TASK = 10_000
CLASSIFIED_AT_LEAST = 1_000


def feature_table(base: Dashboard, numbered: bool = True) -> DataFrame:
    """Pillar means per company name and sector, complete rows only, with their sum and a row number.

    Every model reads the numbered table several times, so it is materialised. So are the means, since numbering counts, samples
    and moves its rows.
    """
    wide = pillar_means(base, *KEY).withColumn("total", sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])))
    return checkpointed(dense_ids(checkpointed(wide), KEY, "row_id")) if numbered else wide


def enough_companies(features: DataFrame, least: int = LEAST_COMPANIES) -> bool:
    return features.limit(least).count() == least


def gated(features: DataFrame, least: int = LEAST_COMPANIES) -> DataFrame:
    """The rows a model may learn from: all of them, or none below ``least`` companies."""
    return features if enough_companies(features, least) else features.limit(0)


def quartile_grades(features: DataFrame, value: str = "total") -> DataFrame:
    """Grade by quartile, edges closed on the right. Equal edges are an error, as no grade could be told apart."""
    names = ("e0", "e1", "e2", "e3", "e4")
    edges = exact_percentiles(features, value, dict(zip(names, (0.0, 0.25, 0.5, 0.75, 1.0))))
    same = F.lit(False)
    for a, b in zip(names, names[1:]):
        same = same | (F.col(a) == F.col(b))
    checked = edges.select(
        F.when(same, F.raise_error(F.lit("quartile edges must be unique")).cast("array<double>"))
        .otherwise(F.array("e1", "e2", "e3"))
        .alias("cuts")
    )
    v, cut = F.col(value), F.col("_cuts")
    grade = F.when(v <= cut[0], GRADES[0]).when(v <= cut[1], GRADES[1]).when(v <= cut[2], GRADES[2]).otherwise(GRADES[3])
    return features.withColumn("_cuts", checked.scalar()).withColumn("grade", grade).drop("_cuts")


def split(features: DataFrame, seed: int = SEED, share: float = 0.2) -> DataFrame:
    return hold_out(features, KEY, seed, share)


def stratified_split(graded: DataFrame, seed: int = SEED, share: float = 0.2) -> DataFrame:
    return hold_out(graded, KEY, seed, share, strata=["grade"])


def folds(features: DataFrame, k: int = 5) -> DataFrame:
    return contiguous_folds(features, ["row_id"], k)


def stratified_folds(graded: DataFrame, k: int = 5) -> DataFrame:
    return contiguous_folds(graded, ["row_id"], k, strata=["grade"])


# --- regression ------------------------------------------------------------------------------------------


def regress(train: DataFrame, query: DataFrame, k: int = 7) -> DataFrame:
    """Predicted total of each query row (columns row_id, predicted)."""
    return predict(nearest_neighbours(train, query, FEATURES, "row_id", k)).withColumnRenamed("query_key", "row_id")


def hold_out_regression(features: DataFrame, k: int = 7, seed: int = SEED) -> DataFrame:
    """Observed and predicted totals of the test rows; none below the gate."""
    parts = checkpointed(split(gated(features), seed))
    test = parts.where("is_test")
    guess = regress(parts.where("not is_test"), test, k)
    return test.join(guess, "row_id").select("row_id", *KEY, F.col("total").alias("observed"), "predicted")


def fold_regression(features: DataFrame, k: int = 7, n_folds: int = 5) -> DataFrame:
    """Every row predicted from the other folds, in one job; none below the gate."""
    parts = checkpointed(folds(gated(features), n_folds))
    guess = predict(nearest_neighbours(parts, parts, FEATURES, "row_id", k, apart="fold"))
    return parts.join(guess, F.col("row_id") == F.col("query_key")).select(
        "row_id", "fold", F.col("total").alias("observed"), "predicted"
    )


def regression_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """Root mean squared error and R2 of (observed, predicted)."""
    miss = F.col("observed") - F.col("predicted")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (1 - F.try_divide(F.sum(miss * miss), F.var_pop("observed") * F.count("observed"))).alias("r2"),
    )


def fold_r2(features: DataFrame, k: int = 7, n_folds: int = 5) -> DataFrame:
    per_fold = regression_scores(fold_regression(features, k, n_folds), "fold")
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), F.avg("r2").alias("mean_r2"))


# --- classification --------------------------------------------------------------------------------------


def _label() -> Column:
    out = F.when(F.col("grade") == GRADES[0], 0.0)
    for i, g in enumerate(GRADES[1:], start=1):
        out = out.when(F.col("grade") == g, float(i))
    return out


def _grade_of(label: str) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), (F.col(label) + 1).cast("int"))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


class PartsInTurn:
    """Parts of a forest that are fitted when they are read and not kept. A part is in the driver from its fit until the next one
    is read, and as many parts are there as ``slots`` lets in, those of other forests included. The first part shows how many
    nodes a tree has; the others have as many trees as make ``NODES_A_FIT``."""

    def __init__(self, rows: DataFrame, fit: Callable[..., RandomForestClassificationModel], num_trees: int, slots: Semaphore):
        self._rows, self._fit, self._num_trees, self._slots = rows, fit, num_trees, slots

    def __iter__(self) -> Iterator[RandomForestClassificationModel]:
        part, size, left = 0, TREES_A_FIT, self._num_trees
        while left:
            size = min(size, left)
            with self._slots:
                model = self._fit(self._rows, part, size)
                part, left, size = part + 1, left - size, max(1, NODES_A_FIT * size // model.totalNumNodes)
                yield model
                del model
            # Shuffles, broadcasts and checkpoints of the part go when the driver's collector has seen that nothing refers to them.
            # Meanwhile a forest that waits takes the slot.
            self._rows.sparkSession.sparkContext._jvm.System.gc()


@dataclass(frozen=True)
class Forest:
    """A random forest as the parts it was fitted in, all held or one after the other."""

    parts: tuple[RandomForestClassificationModel, ...] | PartsInTurn
    num_trees: int


def tasks_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))


def _training_rows(graded: DataFrame, cores: int = 1) -> DataFrame:
    """Features, label and weight, materialised; each class weighs n / (classes * class size).

    Every task holds the class counts per bin of all nodes of a level and sends them on, so there are as many tasks as the
    rows need, not as many as the shuffles before had; smaller ones only where a fit has several ``cores`` to itself.
    """
    sizes = {r.grade: r.n for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for grade, n in sizes.items():
        weight = F.when(F.col("grade") == grade, total / (len(sizes) * n)).otherwise(weight)
    rows = assembled(graded).select("features", _label().alias("label"), weight.alias("weight"))
    tasks = max(tasks_for(total, TRAINED_A_TASK), min(cores, tasks_for(total, TRAINED_AT_LEAST)))
    return checkpointed(rows.repartition(tasks))


def fit_forests(
    samples: Sequence[DataFrame], num_trees: int = 300, max_depth: int = 12, seed: int = SEED, max_bins: int = 64,
    held: bool = True,
) -> list[Forest]:
    """One random forest on the grades of each sample.

    The levels of a tree follow one another, trees do not: the forests are fitted in parts of some trees, each with a seed of
    its own, side by side, more of them than there are cores, so that none is idle while the last parts end. Every level starts
    from the node a row has reached, which is kept per tree: else each row walks all trees from their roots, level by level.

    One forest of many rows fills much of a driver, and so does the garbage of many fits. Of forests that are not ``held`` only
    the training rows are made; each part is fitted when it is read, and few parts are there at a time.
    """
    sizes = [min(TREES_A_FIT, num_trees - at) for at in range(0, num_trees, TREES_A_FIT)]
    context = samples[0].sparkSession.sparkContext
    side = inheritable_thread_target(samples[0].sparkSession)

    def fit(rows: DataFrame, part: int, size: int) -> RandomForestClassificationModel:
        return RandomForestClassifier(
            numTrees=size, maxDepth=max_depth, seed=seed + part, maxBins=max_bins, weightCol="weight",
            cacheNodeIds=True, rawPredictionCol=f"_votes{part}", probabilityCol="", predictionCol="",
        ).fit(rows)

    with ThreadPoolExecutor(max(2, FITS_A_CORE * context.defaultParallelism)) as pool:
        at_a_time = max(1, min(len(samples), context._jvm.Runtime.getRuntime().maxMemory() // HEAP_A_FIT))
        cores = 1 if held else context.defaultParallelism // at_a_time
        trains = list(pool.map(side(partial(_training_rows, cores=cores)), samples))
        if not held:
            slots = Semaphore(at_a_time)
            return [Forest(PartsInTurn(rows, fit, num_trees, slots), num_trees) for rows in trains]
        fitted = [[pool.submit(side(fit), rows, part, size) for part, size in enumerate(sizes)] for rows in trains]
        return [Forest(tuple(part.result() for part in parts), num_trees) for parts in fitted]


def fit_forest(
    graded: DataFrame, num_trees: int = 300, max_depth: int = 12, seed: int = SEED, max_bins: int = 64
) -> Forest:
    return fit_forests([graded], num_trees, max_depth, seed, max_bins)[0]


def classify(model: Forest, rows: DataFrame) -> DataFrame:
    """Grade by the mean class probabilities of all trees; of equal ones the first. Every task reads the whole forest, so
    there are as many as the rows need, or one for each core while they are few. The parts vote one after the other, and
    the sums of their votes are materialised, so no job and no plan holds more than one part."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(tasks_for(n, CLASSIFIED_A_TASK), min(cores, tasks_for(n, CLASSIFIED_AT_LEAST)))
    scored = assembled(rows.repartition(tasks))
    for part in model.parts:
        name = part.getRawPredictionCol()
        votes = vector_to_array(name)
        if "_votes" in scored.columns:
            votes = F.zip_with("_votes", votes, lambda before, more: before + more)
        scored = checkpointed(part.transform(scored).withColumn("_votes", votes).drop(name))
        del part  # else it is held while the next one is fitted
    return (
        scored.withColumn("_shares", F.transform("_votes", lambda v: v / model.num_trees))
        .withColumn("confidence", F.array_max("_shares"))
        .withColumn("_label", F.array_position("_shares", F.col("confidence")) - 1)
        .withColumn("predicted_grade", _grade_of("_label"))
        .drop("features", "_votes", "_shares", "_label")
    )


def unclassified(graded: DataFrame) -> DataFrame:
    return graded.limit(0).withColumn("predicted_grade", F.lit(None).cast("string"))


def hold_out_classification(graded: DataFrame, num_trees: int = 300, max_depth: int = 12, seed: int = SEED) -> DataFrame:
    """Observed and predicted grades of the test rows of one aligned, stratified split; none below the gate."""
    if not enough_companies(graded):
        return unclassified(graded).select("row_id", "grade", "predicted_grade")
    parts = checkpointed(stratified_split(graded, seed))
    model = fit_forest(parts.where("not is_test"), num_trees, max_depth, seed)
    return classify(model, parts.where("is_test")).select("row_id", "grade", "predicted_grade")


def fold_classification(
    graded: DataFrame, num_trees: int = 300, max_depth: int = 12, n_folds: int = 5, seed: int = SEED
) -> DataFrame:
    """One forest per fold; every row is classified by the forest that has not seen it. None below the gate."""
    if not enough_companies(graded):
        return unclassified(graded).select("row_id", F.lit(0).alias("fold"), "grade", "predicted_grade")
    parts = checkpointed(stratified_folds(graded, n_folds))
    trains = [parts.where(F.col("fold") != fold) for fold in range(n_folds)]
    fitted = fit_forests(trains, num_trees, max_depth, seed, held=False)
    others = [parts.where(F.col("fold") == fold) for fold in range(n_folds)]
    with ThreadPoolExecutor(n_folds) as pool:
        guesses = list(pool.map(inheritable_thread_target(graded.sparkSession)(classify), fitted, others))
    return reduce(DataFrame.unionByName, [g.select("row_id", "fold", "grade", "predicted_grade") for g in guesses])


def classification_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """Accuracy and macro F1 from the confusion counts."""
    cells = pairs.groupBy(*keys, "grade", "predicted_grade").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("grade") == F.col("predicted_grade"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("grade").alias("g"), hit.alias("tp"), F.col("n").alias("seen"), F.col("n").alias("c")),
        F.struct(F.col("predicted_grade").alias("g"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("seen"), F.lit(0).cast("bigint").alias("c")),
    )
    per_class = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.g")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.seen").alias("seen"), F.sum("s.c").alias("c"))
    )
    return per_class.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("c").cast("double")).alias("accuracy"),
        F.avg(2.0 * F.col("tp") / F.col("seen")).alias("macro_f1"),
    )


def fold_f1(graded: DataFrame, num_trees: int = 300, max_depth: int = 12, n_folds: int = 5) -> DataFrame:
    per_fold = classification_scores(fold_classification(graded, num_trees, max_depth, n_folds), "fold")
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), F.avg("macro_f1").alias("mean_macro_f1"))


def importances(model: Forest, rows: DataFrame) -> DataFrame:
    """Importance per pillar, smallest first. ``rows`` only names the session."""
    summed = sum(part.getNumTrees * part.featureImportances.toArray() for part in model.parts)
    pairs = [(p, float(v)) for p, v in zip(PILLARS, summed / (summed.sum() or 1.0))]
    return rows.sparkSession.createDataFrame(pairs, "pillar string, importance double").orderBy("importance", "pillar")


# --- new rows --------------------------------------------------------------------------------------------


def default_row(features: DataFrame) -> DataFrame:
    """Feature medians: the row an empty form stands for."""
    return side_by_side([(exact_percentiles(features, f, {f: 0.5}), {f: f}) for f in FEATURES])


def score_rows(model: Forest, train: DataFrame, rows: DataFrame, k: int = 7) -> DataFrame:
    """Predicted total and grade for a batch of new rows (row_id and the three features)."""
    graded = classify(model, rows.select("row_id", *FEATURES))
    return graded.join(regress(train, rows, k), "row_id").withColumnRenamed("predicted", "predicted_total")
