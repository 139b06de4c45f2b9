"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

Fingerprints within ``MAX_BITS`` bits are linked. Cut into ``MAX_BITS // 2 + 1`` segments, two such fingerprints
have a segment that differs by at most one bit; with that bit masked out the segments are equal. So each distinct
fingerprint is indexed under 64 keys - one per bit, the segment of the bit without it - and only fingerprints that
share a key are compared. Frequent keys are cut into blocks that are compared pairwise; whatever its size, a block
pair yields at most one link per member, a spanning forest of its links, never all pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; repeated rows and
rows of equal text share a fingerprint, of which there is one node; a null id never names a component unless all ids
are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.rows import sized_broadcast
from .common import materialised
from .components import connected

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members of a key compared in one block; a task holds two blocks at a time.
BLOCK = 512
#: Runs up to this size are compared for all runs of a batch at once.
SHORT = 8


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; the bytes methods lower and split on ASCII characters only."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        prints = np.fromiter(map(simhash, batch), np.uint64, len(batch))
        yield pd.Series(prints.view(np.int64))


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    count = max_bits // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def variant_keys(fingerprint: Column, max_bits: int = MAX_BITS) -> Column:
    """One key per bit: the bit's number and its segment with the bit masked out."""
    keys = []
    for lo, width in segments(max_bits):
        segment = F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            kept = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(kept.bitwiseOR(F.lit((lo + bit) << width)) if width < 57 else F.xxhash64(F.lit(lo + bit), kept))
    return F.array(*keys)


def find_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links that connect what is within ``max_bits`` bits; ``prints`` has distinct ``fingerprint``."""
    keyed = prints.select("fingerprint", F.explode(variant_keys(F.col("fingerprint"), max_bits)).alias("key"))
    frequent = (
        keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).alias("blocks"))
    )
    # The list of frequent keys is counted; it is sent to the rows only while it is short.
    members = keyed.join(sized_broadcast(frequent), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    members = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "key",
            F.shiftleft(F.least("own", "other"), 31).bitwiseOR(F.greatest("own", "other")).alias("pair"),
            "fingerprint",
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in link_runs(batches, max_bits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (
        members.repartition("key", "pair")
        .sortWithinPartitions("key", "pair")
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def link_runs(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of rows of equal key and block pair; a run may go on in the next batch."""
    rest = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        first = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        rest = rows[:, first[-1] :]
        if len(first) > 1:
            yield link_sorted(rows[2, : first[-1]], first, max_bits)
    if rest is not None and rest.shape[1]:
        yield link_sorted(rest[2], np.array([0, rest.shape[1]]), max_bits)


def link_sorted(prints: np.ndarray, bounds: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the runs between ``bounds``: all of short ones, a spanning forest of each long one."""
    sizes, values = np.diff(bounds), prints.view(np.uint64)
    out_a, out_b = [], []
    left = np.repeat(bounds[1:], sizes) - np.arange(len(values))  # rows from here to the end of the run
    left[np.repeat(sizes > SHORT, sizes)] = 0
    for apart in range(1, SHORT):
        at = np.flatnonzero(left > apart)
        at = at[np.bitwise_count(values[at] ^ values[at + apart]) <= max_bits]
        out_a.append(prints[at])
        out_b.append(prints[at + apart])
    for run in np.flatnonzero(sizes > SHORT):
        own = np.unique(prints[bounds[run] : bounds[run + 1]])
        near = np.bitwise_count(own.view(np.uint64)[:, None] ^ own.view(np.uint64)[None, :]) <= max_bits
        free = np.ones(len(own), bool)
        while free.any():
            start = int(free.argmax())
            free[start] = False
            reached = [start]
            for node in reached:
                new = np.flatnonzero(near[node] & free)
                free[new] = False
                reached.extend(new.tolist())
            out_a.append(np.repeat(own[start], len(reached) - 1))
            out_b.append(own[reached[1:]])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``fingerprint`` (bigint), ``root`` and ``component_id``.

    ``root`` is the smallest fingerprint that links reach, ``component_id`` the smallest id. Where an id is repeated,
    two components may have it as their smallest.
    """
    rows = materialised(docs.select(id_col, *keep, fingerprint_of(text).alias("fingerprint")))
    prints = materialised(rows.groupBy("fingerprint").agg(F.min(id_col).alias("_first")))
    links = connected(find_links(prints))
    rooted = materialised(
        prints.join(links, prints["fingerprint"] == links["node"], "left")
        .select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "root", "component_id")
    return rows.join(named, "fingerprint")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; of rows that share this id the smallest text hash.

    Only id and text hash of the chosen rows are joined to the documents. Rows that repeat both stay once.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = near_duplicates(docs.withColumn("_digest", digest), id_col, text, ("_digest",))
    first = F.min(F.when(F.col(id_col).eqNullSafe(F.col("component_id")), F.col("_digest")))
    chosen = marked.groupBy("root").agg(F.min("component_id").alias("component_id"), first.alias("_chosen"))
    numbered = docs.withColumn("_digest", digest)
    same = numbered[id_col].eqNullSafe(chosen["component_id"]) & (numbered["_digest"] == chosen["_chosen"])
    return numbered.join(chosen, same, "left_semi").dropDuplicates([id_col, "_digest"]).select(*docs.columns)
