"""Exact nearest neighbours without comparing every query with every training row.

Space is cut into boxes of about equal training size (cut points from a bounded hash sample of the distinct points). A
query is first matched inside its own box; the distance of its k-th neighbour there bounds the search, and only boxes
whose rows this ball touches are visited in the second step. A query whose own box has too few rows takes its bound
from the farthest corner of the nearest boxes that have enough. Boxes with many queries or many training rows are split
over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed

_PAIR_BUDGET = 2_000_000  # distances held at once inside a task


@dataclass(frozen=True)
class Boxes:
    """A complete binary partition of space: ``levels[i]`` has 2**i thresholds on dimension i % d."""

    levels: tuple[np.ndarray, ...]
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for depth, thresholds in enumerate(self.levels):
            node = 2 * node + (points[:, depth % points.shape[1]] > thresholds[node])
        return node

    def distance2(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each box; never above that to a row inside the box."""
        out = np.zeros((len(points), len(self.low)))
        for j in range(points.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - points[:, [j]], points[:, [j]] - self.high[:, j]), 0.0)
            out += gap * gap
        return out


@dataclass(frozen=True)
class Spans:
    """What the training rows of each box span, and how many of them every query may use."""

    low: np.ndarray
    high: np.ndarray
    usable: np.ndarray

    def near2(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each span; never above that to a row of the box."""
        out = np.zeros((len(points), len(self.low)))
        for j in range(points.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - points[:, [j]], points[:, [j]] - self.high[:, j]), 0.0)
            out += gap * gap
        return out

    def radius2(self, points: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each point has ``k`` rows; infinite if there are not so many at all."""
        far = np.zeros((len(points), len(self.low)))
        for j in range(points.shape[1]):
            gap = np.maximum(np.abs(points[:, [j]] - self.low[:, j]), np.abs(points[:, [j]] - self.high[:, j]))
            far += gap * gap
        order = np.argsort(far, axis=1, kind="stable")
        reached = np.cumsum(self.usable[order], axis=1) >= k
        first = order[np.arange(len(points)), reached.argmax(axis=1)]
        return np.where(reached.any(axis=1), far[np.arange(len(points)), first], np.inf)


def cut_boxes(sample: np.ndarray, depth: int) -> Boxes:
    d = sample.shape[1]
    low, high = np.full((1, d), -np.inf), np.full((1, d), np.inf)
    members, levels = [sample], []
    for level in range(depth):
        j = level % d
        cuts = np.array([np.median(m[:, j]) if len(m) else np.inf for m in members])
        levels.append(cuts)
        members = [part for m, c in zip(members, cuts) for part in (m[m[:, j] <= c], m[m[:, j] > c])]
        low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        high[0::2, j] = np.minimum(high[0::2, j], cuts)
        low[1::2, j] = np.maximum(low[1::2, j], cuts)
    return Boxes(tuple(levels), low, high)


def _nearest(queries: np.ndarray, q_group, points: np.ndarray, p_group, p_key: np.ndarray, k: int):
    """Yield, chunk by chunk, the k nearest points of each query by (squared distance, key)."""
    order = np.argsort(p_key, kind="stable")
    points, p_group = points[order], None if p_group is None else p_group[order]
    step, few = max(1, _PAIR_BUDGET // max(1, len(points))), min(k, len(points))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        d2 = np.zeros((len(q), len(points)))
        for j in range(q.shape[1]):
            gap = q[:, [j]] - points[:, j]
            d2 += gap * gap
        if p_group is not None:
            d2[q_group[at : at + step][:, None] == p_group] = np.inf
        # Everything up to the k-th distance, ties included; columns are in key order already.
        limit = np.partition(d2, few - 1, axis=1)[:, few - 1]
        row, col = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
        near = d2[row, col]
        best = np.lexsort((col, near, row))
        row, col, near = row[best], col[best], near[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield at + row[kept], order[col[kept]], near[kept]


def nearest_neighbours(
    train: DataFrame,
    query: DataFrame,
    features: Sequence[str],
    key: str,
    k: int = 7,
    target: str = "total",
    apart: str | None = None,
    box_rows: int = 4_096,
    query_rows: int = 20_000,
) -> DataFrame:
    """The k nearest training rows per query row: query_key, neighbour_key, target, d2.

    Ties in distance go to the smaller key. With ``apart``, rows that share its value never meet (folds).
    """
    features, extra = list(features), [apart] if apart else []
    d = len(features)
    t = train.select(F.col(key).cast("bigint").alias("key"), *[F.col(f).cast("double") for f in features],
                     F.col(target).cast("double").alias("y"), *[F.col(a).alias("grp") for a in extra])
    # Of training rows at the same point only the k smallest keys can ever be chosen. Cut points are drawn from what is
    # left, so a point that many rows share does not take them all.
    same = Window.partitionBy(*features, *(["grp"] if extra else [])).orderBy("key")
    t = checkpointed(t.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy"))
    n = t.count()
    # At most 2**14 boxes, whose cuts and spans the driver holds; fuller boxes are split below.
    depth = max(0, min(14, int(np.ceil(np.log2(max(1, n / box_rows))))))
    taken = t.orderBy(F.xxhash64("key")).limit(16 << depth).select(*features).collect() if depth else []
    boxes = cut_boxes(np.array([tuple(r) for r in taken], dtype=float).reshape(-1, d), depth)

    q = query.select(F.col(key).cast("bigint").alias("key"), *[F.col(f).cast("double") for f in features],
                     *[F.col(a).alias("grp") for a in extra])

    @F.pandas_udf("int")
    def box_of(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for c in columns:
            yield pd.Series(boxes.of(np.column_stack([np.asarray(s, dtype=float) for s in c])))

    t = checkpointed(t.withColumn("box", box_of(*features)))
    q = checkpointed(q.withColumn("box", box_of(*features)))
    found = "query_key bigint, neighbour_key bigint, target double, d2 double"

    def match(probes: DataFrame) -> DataFrame:
        # At most 2**14 counts; they say over how many tasks the queries of a box are spread.
        split = parts_of(probes, query_rows)
        left = probes.withColumn("part", F.pmod(F.xxhash64("key"), split).cast("int")).withColumn("slice", all_parts(pieces))
        right = t.withColumn("part", all_parts(split)).withColumn("slice", F.pmod(F.xxhash64("key"), pieces).cast("int"))

        def local(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            hits = [
                pd.DataFrame({"query_key": p["key"].to_numpy()[a], "neighbour_key": r["key"].to_numpy()[b],
                              "target": r["y"].to_numpy()[b], "d2": dist})
                for a, b, dist in _nearest(
                    p[features].to_numpy(float), p["grp"].to_numpy() if extra else None,
                    r[features].to_numpy(float), r["grp"].to_numpy() if extra else None, r["key"].to_numpy(), k)
            ] if len(p) and len(r) else []
            return pd.concat(hits) if hits else pd.DataFrame(
                {"query_key": [], "neighbour_key": [], "target": [], "d2": []}).astype(
                {"query_key": "int64", "neighbour_key": "int64", "target": "float64", "d2": "float64"})

        group = ("box", "part", "slice")
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(local, found)

    def parts_of(rows: DataFrame, most: int) -> Column:
        """Into how many parts the rows of a box are cut. At most 2**14 counts reach the driver."""
        counts = rows.groupBy("box").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).collect()
        if not counts:
            return F.lit(1)
        held = F.create_map(*[F.lit(x) for r in counts for x in (r.box, 1 + r.n // most)])
        return F.coalesce(F.try_element_at(held, F.col("box")), F.lit(1))

    def all_parts(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))

    pieces = parts_of(t, 4 * box_rows)
    rank = Window.partitionBy("query_key").orderBy("d2", "neighbour_key")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")

    if depth == 0:
        return best(match(q))
    spans = spans_of(t, features, 1 << depth, bool(extra))
    first = checkpointed(best(match(q)))
    reach = first.groupBy("query_key").agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("r2"))
    open_q = q.join(reach, F.col("key") == F.col("query_key"), "left").select(
        *q.columns, F.when(F.col("c") >= k, F.col("r2")).otherwise(F.lit(float("inf"))).alias("r2")
    )
    schema = open_q.drop("r2").schema

    def other_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _PAIR_BUDGET // len(spans.low))
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.iloc[at : at + step]
                where, r2 = b[features].to_numpy(float), b["r2"].to_numpy().copy()
                short = np.isinf(r2)
                r2[short] = spans.radius2(where[short], k)
                touched = spans.near2(where) <= r2[:, None]
                touched[np.arange(len(b)), b["box"].to_numpy()] = False
                row, box = np.nonzero(touched)
                out = b.iloc[row].drop(columns="r2")
                yield out.assign(box=box.astype("int32"))

    second = match(checkpointed(open_q.mapInPandas(other_boxes, schema)))
    return best(first.unionByName(second))


def spans_of(rows: DataFrame, features: Sequence[str], boxes: int, grouped: bool) -> Spans:
    """One row per box reaches the driver. Where rows of one group never meet, those of a box's largest group are not
    counted as usable, whatever group a query is of."""
    keys = ["box", "grp"] if grouped else ["box"]
    edges = [f(c).alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max))]
    per_group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *edges)
    usable = F.sum("n") - F.max("n") if grouped else F.sum("n")
    outer = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max))]
    low, high = np.full((boxes, len(features)), np.inf), np.full((boxes, len(features)), -np.inf)
    count = np.zeros(boxes, np.int64)
    for r in per_group.groupBy("box").agg(usable.alias("n"), *outer).collect():
        count[r.box] = r.n
        low[r.box] = [r[f"low_{c}"] for c in features]
        high[r.box] = [r[f"high_{c}"] for c in features]
    return Spans(low, high, count)


def predict(neighbours: DataFrame) -> DataFrame:
    """Distance-weighted mean of the neighbours' targets; neighbours at distance 0 decide alone."""
    d = F.sqrt("d2")
    return neighbours.groupBy("query_key").agg(
        F.when(F.min("d2") == 0, F.avg(F.when(F.col("d2") == 0, F.col("target"))))
        .otherwise(F.try_divide(F.sum(F.try_divide(F.col("target"), d)), F.sum(F.try_divide(F.lit(1.0), d))))
        .alias("predicted")
    )
