"""Exact percentiles and box figures of a ``Dashboard`` without moving single facts to their labels.

Values are put into bins, equally wide on a logarithmic scale, so that no pass has to look for their span. The facts are
counted per company, fact key and bin, so that what is joined to the labels and weighted by ``copies`` is at most one
row per company and bin. The sums of the bins tell which few hold a wanted rank; only their values are counted one by one,
again per company first. Bins only say where to look: the result is exact whatever the distribution. Where a wanted bin
may hold very many different values, they are sorted over many tasks by ``running_total``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed
from .dashboard import VALUE, W, Dashboard
from .ordering import running_total
from .rows import counted_broadcast

#: Bins for each factor e: one spans 0.4 % of its values.
RESOLUTION = 256
#: Rows of a wanted bin that one task may sort; its weight is known and is never less than its number of values.
TASK_ROWS = 1_000_000
MAX_BROADCAST = 10_000
BIN = "_bin"
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def log_bin(value: Column) -> Column:
    """Number of a value's bin, which never falls where the value rises; NaN, the largest value, has the last one."""
    # Logarithms of doubles lie between -745 and 710; 746 makes all of them positive.
    size = (F.floor((F.least(F.ln(F.abs(value)), F.lit(710.0)) + 746) * RESOLUTION)).cast("int")
    return F.when(F.isnan(value), 1 << 30).when(value > 0, size).when(value < 0, -size).otherwise(0)


class Bins:
    """The facts of a dashboard counted by key and bin, on reliable storage, and the way back to the facts of a bin.

    ``number`` gives a value its bin and must never fall where the value rises. ``parts`` are the parts of ``base`` by the
    same bins where they are known already, so that the facts are not counted again.
    """

    def __init__(
        self, base: Dashboard, keys: Sequence[str] = (), number: Callable[[Column], Column] = log_bin,
        parts: DataFrame | None = None,
    ):
        kept = base.where_facts(F.col(VALUE).isNotNull())
        self.base = kept.with_facts(**{BIN: number(F.col(VALUE))})
        self.keys = list(keys)
        if parts is None:
            counted = self.base.counts(*keys, BIN, least=(F.min, VALUE), most=(F.max, VALUE))
        else:
            known = parts.dropna(subset=[*keys, "least"])
            counted = known.groupBy(*keys, BIN).agg(
                F.sum(F.col("n") * F.col(W)).cast("bigint").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
            )
        ordered = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, 0)
        self.cells = checkpointed(
            counted.withColumn("prior", F.sum("n").over(ordered) - F.col("n"))
            .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        )

    def values(self, wanted: DataFrame) -> DataFrame:
        """Keys, bin, value and n of the values in the bins of ``wanted`` (keys and bin, each pair once), with its other
        columns."""
        fact_keys = [k for k in self.keys if k in self.base.facts.columns]
        # The facts know their own keys only; label keys are compared after the join.
        places = wanted.select(*fact_keys, BIN).distinct()
        near = self.base.facts.join(places, [*fact_keys, BIN], "left_semi")
        counted = Dashboard(near, self.base.labels).counts(*self.keys, BIN, VALUE)
        return counted.join(wanted, [*self.keys, BIN])

    def percentiles(self, probs: Mapping[str, float]) -> DataFrame:
        """Linearly interpolated percentiles per key, one column per entry of ``probs``."""

        def position(p: float) -> Column:
            return F.lit(float(p)) * (F.col("total") - 1)

        ranks = F.array(*[r for p in probs.values() for r in (F.floor(position(p)), F.ceil(position(p)))])
        after = F.col("prior") + F.col("n")
        holding = self.cells.withColumn("_ranks", ranks).where(
            F.exists("_ranks", lambda r: (r >= F.col("prior")) & (r < after))
        )
        rows, heaviest = holding.agg(F.count(F.lit(1)), F.max("n")).first()
        wanted = holding.select(*self.keys, BIN, "prior", "total")
        counted = self.values(F.broadcast(wanted) if rows <= MAX_BROADCAST else wanted)
        groups = [*self.keys, BIN]
        if (heaviest or 0) <= TASK_ROWS:
            inside = Window.partitionBy(*groups).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
            placed = counted.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
        else:
            placed = running_total(counted, [VALUE], F.col("n"), groups, "_before")
        first = F.col("prior") + F.col("_before")

        def at(rank: Column) -> Column:
            return F.max(F.when((first <= rank) & (rank < first + F.col("n")), F.col(VALUE)))

        picks = []
        for i, p in enumerate(probs.values()):
            picks += [at(F.floor(position(p))).alias(f"_lo{i}"), at(F.ceil(position(p))).alias(f"_hi{i}")]
        picked = placed.groupBy(*self.keys).agg(F.max("total").alias("total"), *picks)
        between = {
            n: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position(p) - F.floor(position(p)))
            for i, (n, p) in enumerate(probs.items())
        }
        return picked.select(*self.keys, *[c.alias(n) for n, c in between.items()])

    def approximate(self, probs: Mapping[str, float]) -> DataFrame:
        """The same percentiles from the bins alone, without a second look at the facts.

        Bins with their count, least and largest value are sketches: those of companies merge by adding, weighted by
        ``copies``. The bin of a wanted rank is exact, so the rank is off by less than the bin's rows and the value by less
        than the bin's width, 1 / ``RESOLUTION`` of it; inside the bin the value is interpolated.
        """
        after = F.col("prior") + F.col("n")

        def at(rank: Column) -> Column:
            inside = F.coalesce(F.try_divide(rank - F.col("prior"), F.col("n") - 1), F.lit(0.0))
            value = F.col("least") + (F.col("most") - F.col("least")) * inside
            return F.max(F.when((F.col("prior") <= rank) & (rank < after), value))

        # The two ranks around a wanted place may lie in different bins.
        picks = []
        for name, p in probs.items():
            rank = F.lit(float(p)) * (F.col("total") - 1)
            low, high, share = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
            picks.append((low + (high - low) * share).alias(name))
        return self.cells.groupBy(*self.keys).agg(*picks)

    def fences(self) -> DataFrame:
        """Quartiles and the values 1.5 interquartile ranges beyond them."""
        reach = (F.col("q3") - F.col("q1")) * 1.5
        return self.percentiles(QUARTILES).withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})

    def boxes(self) -> DataFrame:
        """Quartiles, whisker ends within the fences and the number of values beyond them, per key.

        Bins between those of the two fences lie inside, bins beyond them outside; only the values of the fences' own
        bins are looked at one by one.
        """
        fences = checkpointed(self.fences())
        marked = fences.withColumns({f"_{c}": log_bin(F.col(f"fence_{c}")) for c in ("low", "high")})
        low, high, here = F.col("_low"), F.col("_high"), F.col(BIN)
        if self.keys:
            cells = self.cells.join(counted_broadcast(marked), self.keys)
        else:
            cells = self.cells.withColumns({c: marked.select(c).scalar() for c in marked.columns})
        cells = cells.drop("prior", "total")
        own = (here == low) | (here == high)
        inner = (here > low) & (here < high)
        whole = cells.where(~own).select(
            *self.keys, *QUARTILES, F.when(inner, F.col("least")).alias("a"), F.when(inner, F.col("most")).alias("b"),
            F.when(inner, 0).otherwise(F.col("n")).alias("beyond"),
        )
        edges = cells.where(own).select(*self.keys, BIN, *QUARTILES, "fence_low", "fence_high")
        single = self.values(counted_broadcast(edges, MAX_BROADCAST))
        inside = F.when(F.col(VALUE).between(F.col("fence_low"), F.col("fence_high")), F.col(VALUE))
        single = single.select(
            *self.keys, *QUARTILES, inside.alias("a"), inside.alias("b"),
            F.when(inside.isNotNull(), 0).otherwise(F.col("n")).alias("beyond"),
        )
        return whole.unionByName(single).groupBy(*self.keys).agg(
            *[F.max(q).alias(q) for q in QUARTILES], F.min("a").alias("whisker_low"), F.max("b").alias("whisker_high"),
            F.coalesce(F.sum("beyond"), F.lit(0)).cast("bigint").alias("outliers"),
        )


def percentiles(base: Dashboard, probs: Mapping[str, float], *keys: str) -> DataFrame:
    return Bins(base, keys).percentiles(probs)
