"""What each of five document filters removes, in every order of applying them, kept up to date by a stream.

The documents are read as files in available-now micro-batches. Of a text only a digest, the mask of the filters it
fails by itself and its part leave the task that read it. The state keeps for each digest the smallest id seen so far
and the rows that have it: these are no copies, all others fail the filter of copies as well. When a smaller id arrives,
the rows counted as first are retracted from the counters under their earlier mask and added under the new one. Each
micro-batch adds its changes, summed by part and mask, to the counters' folder under its own number, so that a batch
that runs again replaces itself. The report is made of the counters alone: at most 32 masks a part.

Digests with the same leading bits share a state, about ``SHARD_TEXTS`` of them whatever the number of documents. A text
held by a third of all rows meets its state as one row for each Arrow batch, part and label, since rows are counted
before they are shuffled. The state lies in the session's state store; for more texts than fit in the executors' memory
set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.

Defined cases: a null text is an empty one; a null part is the empty string; a null id is never smaller than another
and no id is smaller than it, so its row never fails the filter of copies and makes no other row fail it; rows that
repeat id and text are first together; of contradicting labels of one id the 1 holds; an empty table, or a folder
without files, gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from .common import materialised

#: Filters in the order of their bits; the last one needs the other documents.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Micro-batches a folder is read in, at most.
BATCHES = 4
#: Texts that share a state, on average: a state is called once a batch, and a call costs as much as some hundred texts.
SHARD_TEXTS = 64

MEASURED = "_id long, _unknown boolean, _part string, _mask int, _key string, _shard long"
COUNTED = "_shard long, _key string, _mask int, _part string, _good int, _toxic int, _n long, _unknown boolean, _first long, _firsts long"
COUNTS = ("_key", "_mask", "_part", "_good", "_toxic", "_n", "_unknown", "_first", "_firsts")
CHANGES = "part string, mask int, good int, toxic int, n long"


def own_mask(raw: bytes, length: int) -> int:
    """Bits of the filters that a text fails by itself; ``bytes.split`` parts words as the filters do."""
    words = raw.split()
    mask = int(len(words) < MIN_WORDS)
    mask |= (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * length) << 2
    return mask | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def shard_bits(rows: int) -> int:
    """Leading bits of a digest that make a shard of about ``SHARD_TEXTS`` texts, at most 48."""
    return min(48, max(0, (rows // SHARD_TEXTS).bit_length()))


def measured(docs: DataFrame, id_col: str, text: str, part: str, bits: int) -> DataFrame:
    """A narrow row of each document; ``_key`` is a digest of 128 bits, ``_shard`` its first ``bits``."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["_text"]]
            raw = [t.encode() for t in texts]
            keys = [hashlib.blake2b(b, digest_size=16).hexdigest() for b in raw]
            yield batch[["_id", "_unknown", "_part"]].assign(
                _mask=[own_mask(b, len(t)) for b, t in zip(raw, texts, strict=True)],
                _key=keys, _shard=[int(k[:12], 16) >> 48 - bits for k in keys],
            )

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("_id"), F.col(id_col).isNull().alias("_unknown"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.col(text).alias("_text"),
    )
    return rows.mapInPandas(measure, MEASURED)


def count_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of equal digest, part and labels counted: how many, the smallest id and how many have it.

    Rows without an id (``_unknown``) are a count of their own.
    """
    for batch in batches:
        cells: dict[tuple, list] = {}
        alike = zip(*(batch[c] for c in ("_shard", "_key", "_mask", "_part", "_good", "_toxic", "_unknown")), strict=True)
        for key, own in zip(alike, batch["_id"].tolist(), strict=True):
            cell = cells.setdefault(key, [0, own, 0])
            cell[0] += 1
            if own < cell[1]:
                cell[1:] = [own, 1]
            elif own == cell[1]:
                cell[2] += 1
        yield pd.DataFrame(
            [(*k[:6], n, k[6], first, firsts) for k, (n, first, firsts) in cells.items()],
            columns=["_shard", *COUNTS],
        )


def change_counters(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the rows that one micro-batch has for the texts of one shard.

    The state has of each text the smallest id so far and the rows of that id by part and labels, which are counted
    without the filter of copies.
    """
    texts = json.loads(state.get[0]) if state.exists else {}
    changes: dict[tuple, int] = {}

    def add(cell: tuple, mask: int, n: int) -> None:
        changes[*cell, mask] = changes.get((*cell, mask), 0) + n

    for chunk in chunks:
        for text, mask, part, good, toxic, n, unknown, first, firsts in zip(*(chunk[c].tolist() for c in COUNTS), strict=True):
            cell = (part, good, toxic)
            if unknown:
                add(cell, mask, n)
                continue
            smallest, cells = texts.get(text, (None, []))
            if smallest is None or first < smallest:
                for *earlier, count in cells:  # a smaller id makes copies of what came first
                    add(tuple(earlier), mask, -count)
                    add(tuple(earlier), mask | COPY, count)
                smallest, cells = first, []
            firsts = firsts if first == smallest else 0
            add(cell, mask, firsts)
            add(cell, mask | COPY, n - firsts)
            if firsts:
                same = next((c for c in cells if tuple(c[:3]) == cell), None)
                if same:
                    same[3] += firsts
                else:
                    cells.append([*cell, firsts])
            texts[text] = (smallest, cells)
    if texts:
        state.update((json.dumps(texts, separators=(",", ":")),))
    out = [(part, mask, good, toxic, n) for (part, good, toxic, mask), n in changes.items() if n]
    if out:
        yield pd.DataFrame(out, columns=["part", "mask", "good", "toxic", "n"])


def labels_by_id(labels: DataFrame, id_col: str) -> DataFrame:
    """One row an id, so that a document is one row after the join."""
    ones = [F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"_{n}") for c, n in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where(F.col(id_col).isNotNull())
    return materialised(known.groupBy(F.col(id_col).cast("long").alias("_label_id")).agg(*ones))


def counter_changes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                    part: str = "lang", bits: int = 0) -> DataFrame:
    """A stream of changes of the counters (``CHANGES``) from a stream of documents, with a state for each of the
    2 ** ``bits`` shards of texts."""
    rows = measured(docs, id_col, text, part, bits)
    marks = labels_by_id(labels, id_col)
    known = rows.join(marks, (F.col("_id") == F.col("_label_id")) & ~F.col("_unknown"), "left")
    known = known.select(
        "_id", "_unknown", "_part", "_mask", "_key", "_shard",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_good", "_toxic")],
    )
    return known.mapInPandas(count_alike, COUNTED).groupBy("_shard").applyInPandasWithState(
        change_counters, CHANGES, "texts string", "update", GroupStateTimeout.NoTimeout
    )


def keep_counters(changes: DataFrame, counters: str, checkpoint: str) -> None:
    """Run the stream over all files there are; the sums of each micro-batch lie in a folder of its number."""
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{counters}/batch={number}")

    query = (
        changes.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_counters(spark: SparkSession, counters: str) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic``, ``n`` of what remains after all changes."""
    changes = spark.read.schema(CHANGES).parquet(counters)
    return changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def report(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters of each part.

    A step is known by its filter and the filters before it, in whatever order: 80 steps in 600 places. Of a document
    that fails k filters, a filter removes it in 120 / k of the orders.
    """
    spark = counters.sparkSession
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    places = [
        ("".join(order), step + 1, bit[f], sum(bit[g] for g in order[:step]))
        for order in permutations(FILTERS) for step, f in enumerate(order)
    ]
    steps = sorted({(f, before) for _, _, f, before in places})
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before")) for f, b in steps]))
    cells = counters.select("*", each.alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    fails, earlier = (F.col("mask").bitwiseAND(F.col(c)) != 0 for c in ("filter", "before"))

    def total(when, n=F.col("n")):
        return F.sum(F.when(when, n).otherwise(0)).cast("long")

    removed = fails & ~earlier
    sums = cells.groupBy("part", "filter", "before").agg(
        total(~fails & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("filter")).alias("unique_fails"),
        total(removed, F.col("n") * F.col("good")).alias("good_lost"),
        total(removed, F.col("n") * F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * F.lit(len(places) // 5) / F.bit_count("mask")).alias("shapley"),
    )
    order = spark.createDataFrame(places, "filter_order string, step int, filter int, before int")
    return sums.join(F.broadcast(order), ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_files(spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """The report over all Parquet files of ``path``, read in at most about ``batches`` micro-batches."""
    found = spark.read.parquet(path)
    files = -(-len(found.inputFiles()) // batches)
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads folders and patterns, but no path of a single file
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", max(1, files)).parquet(pattern)
    counters = scratch_path(spark, "filter-counters")
    spark.createDataFrame([], CHANGES).write.parquet(f"{counters}/batch=-1")
    bits = shard_bits(found.count())  # from the footers of the files
    keep_counters(counter_changes(stream, labels, id_col, text, part, bits), counters, scratch_path(spark, "filter-offsets"))
    return report(materialised(read_counters(spark, counters)))
