"""Nearest neighbours through a forest of random-projection trees.

Trees are cut on a bounded sample: a node splits at the median along the difference of two of its points. Every vector
is then routed to one leaf of each tree. A query walks all trees through one priority queue, nearest cell first, until
it has visited enough leaves; the leaf members are compared with it exactly, leaf by leaf in tasks, and only the best of
each leaf move on. Equal vectors are one point that carries its smallest ids, the only ones that can be returned.

Defined cases: a vector that is null, zero, holds a null or non-finite component, or has not the sample's most frequent
length takes no part, nor does a row without id; equal distances go to the smaller id; a row never finds its own id;
repeated rows count once; fewer candidates than asked for give fewer rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

#: Vectors the trees are cut on, at most. Cells get wider with the table beyond it; every row is indexed all the same.
SAMPLE = 32_768
TREES = 12
#: Points a leaf should hold, and splits from a root to a leaf, at most: with the share of leaves below, a query brings
#: back as many rows from a large table as from a small one, and leaves grow instead.
LEAF, DEPTH = 128, 7
#: Leaves a query visits: this share of all leaves of all trees, at least ``VISITS``. Vectors without any structure, the
#: hardest case, need a constant share: 0.944 of the true neighbours were found among 10,256 such vectors of 64
#: components (at a share of 0.05) and 0.95 among 51,282.
VISITS, VISIT_SHARE = 64, 0.06
#: A node's direction joins two centres found from a random draw of its points; a cut between them that leaves less
#: than this share on a side is moved to the median.
MEANS, MEANS_STEPS, LEAST_SHARE = 256, 4, 0.1
#: Points of one leaf that one group compares.
GROUP = 4096


@dataclass(frozen=True)
class Forest:
    """Complete trees in heap order: ``normals`` (tree, node, component) and ``cuts`` (tree, node); a point goes right
    when its product with the normal is above the cut. Leaves are numbered through all trees."""

    normals: np.ndarray
    cuts: np.ndarray

    @property
    def inner(self) -> int:
        return self.cuts.shape[1]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.zeros((len(points), len(self.cuts)), np.int64)
        for tree, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(points), np.int64)
            while self.inner and node.size and node[0] < self.inner:
                right = np.einsum("ij,ij->i", points, normals[node]) > cuts[node]
                node = 2 * node + 1 + right
            out[:, tree] = tree * (self.inner + 1) + node - self.inner
        return out

    def search(self, point: np.ndarray, visits: int) -> list[int]:
        """The leaves around a point, by the queue that all trees share."""
        margins = self.normals @ point - self.cuts
        lengths = np.sqrt((self.normals**2).sum(axis=2))
        margins = margins / np.where(lengths > 0, lengths, 1)
        queue: list[tuple[float, int, int]] = [(-math.inf, tree, 0) for tree in range(len(self.cuts))]
        found: list[int] = []
        while queue and len(found) < visits:
            priority, tree, node = heapq.heappop(queue)
            while node < self.inner:
                margin = float(margins[tree, node])
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                # How far the point is from a cell: the widest cut it has to cross.
                heapq.heappush(queue, (max(priority, abs(margin)), tree, far))
                node = near
            found.append(tree * (self.inner + 1) + node - self.inner)
        return found


def grow(points: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    width = points.shape[1]
    normals, cuts = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    for tree in range(trees):
        members = {0: np.arange(len(points))}
        for node in range(inner):
            own = members.pop(node, np.empty(0, np.int64))
            if len(own) > 1:
                a, b = two_means(points[rng.choice(own, min(len(own), MEANS), replace=False)])
                normals[tree, node] = a - b
                along = points[own] @ normals[tree, node]
                cuts[tree, node] = (a - b) @ (a + b) / 2
                right = along > cuts[tree, node]
                if not LEAST_SHARE <= right.mean() <= 1 - LEAST_SHARE:
                    cuts[tree, node] = np.median(along)
                    right = along > cuts[tree, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
            else:
                members[2 * node + 1] = own
    return Forest(normals, cuts)


def two_means(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two centres, started from the first two points, which are random."""
    a, b = points[0], points[1]
    for _ in range(MEANS_STEPS):
        nearer = ((points - a) ** 2).sum(axis=1) < ((points - b) ** 2).sum(axis=1)
        if nearer.all() or not nearer.any():
            break
        a, b = points[nearer].mean(axis=0), points[~nearer].mean(axis=0)
    return a, b


def usable(vector: str) -> Column:
    """Without nulls and non-finite components, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def distinct_points(rows: DataFrame, id_col: str, vector: str, ids: int) -> DataFrame:
    """``point``, ``ids``: each different vector with its ``ids`` smallest ids in order.

    Ranks are cut before rows of equal vectors meet, so however many there are, few move.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(vector).orderBy(id_col)))
    return (
        ranked.where(F.col("_rank") <= ids)
        .groupBy(F.col(vector).alias("point"))
        .agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    )


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
            sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, visit_share: float = VISIT_SHARE) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` (Euclidean distance) of the ``k`` nearest found of each query."""
    rows = table.select(id_col, vector).where(F.col(id_col).isNotNull() & usable(vector)).distinct()
    first = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).toPandas()
    sizes = first[vector].map(len)
    width = int(sizes.mode().iloc[0]) if len(first) else 0
    rows = rows.where(F.size(vector) == width)
    chosen = first.loc[sizes == width, vector].tolist()
    fit = np.array(chosen, float).reshape(len(chosen), width)
    points = distinct_points(rows, id_col, vector, k + 1)
    total = rows.count()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, min(total / leaf, len(fit) / 4))))))
    forest = grow(fit, trees, depth)
    visits = max(VISITS, math.ceil(visit_share * trees * 2**depth))
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = shared.value.leaves(np.array(batch["point"].tolist(), float).reshape(len(batch), -1))
            yield batch.assign(leaves=at.tolist())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaves=[shared.value.search(np.array(p, float), visits) for p in batch["point"]])

    kinds = dict(table.dtypes)
    id_kind, vector_kind = kinds[id_col], kinds[vector]
    routed = materialised(
        points.mapInPandas(route, f"point {vector_kind}, ids array<{id_kind}>, leaves array<bigint>")
    )
    # One row per leaf: at most `trees` times two to the depth, which the sample bounds.
    busy = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > GROUP)
    parts = {r["leaf"]: -(-r["count"] // GROUP) for r in busy.collect()}
    split = F.lit(1)
    if parts:
        by_leaf = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
        split = F.coalesce(F.element_at(by_leaf, F.col("leaf")), F.lit(1))
    members = routed.select(F.explode("leaves").alias("leaf"), "point", "ids").select(
        "leaf", F.pmod(F.xxhash64("point"), split).alias("part"), "point", "ids"
    )
    queries = rows.where(is_query).select(F.col(id_col).alias("query_id"), F.col(vector).alias("point"))
    walked = queries.mapInPandas(walk, f"query_id {id_kind}, point {vector_kind}, leaves array<bigint>")
    probes = walked.select("query_id", F.explode("leaves").alias("leaf"), "point").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), split.cast("long") - 1)).alias("part"), "query_id", "point"
    )

    def compare(leaf_members: pd.DataFrame, leaf_queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(leaf_members) and len(leaf_queries):
            own = np.array(leaf_members["point"].tolist(), float)
            ids = leaf_members["ids"].to_numpy()
            smallest = np.array([i[0] for i in ids])
            for query, point in zip(leaf_queries["query_id"], leaf_queries["point"], strict=True):
                distance = np.sqrt(((own - np.asarray(point, float)) ** 2).sum(axis=1))
                best = np.lexsort((smallest, distance))[: k + 1]
                found += [(query, distance[i], list(ids[i])) for i in best]
        return pd.DataFrame(found, columns=["query_id", "score", "ids"])

    near = (
        members.groupBy("leaf", "part")
        .cogroup(probes.groupBy("leaf", "part"))
        .applyInPandas(compare, f"query_id {id_kind}, score double, ids array<{id_kind}>")
    )
    pairs = (
        near.select("query_id", "score", F.explode("ids").alias(id_col))
        .where(F.col(id_col) != F.col("query_id"))
        .groupBy("query_id", id_col)
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", id_col, "score"
    )
