"""Removal of passages that repeat, wherever in a line they start and end.

Each text gives windows of three kinds: every three consecutive lines that hold a word (lines as in ``line_dedup``,
however few words they have); the whole text if it has fewer than three such lines; and runs of pieces, which are cut
where a hash of the last two words is the least among ``NEAR`` neighbours, so that equal words are cut alike whatever
stands around them. A run starts at a cut and ends at the first cut that leaves three pieces and ``RUN_WORDS`` words.
Any fifty equal words hold such a run: of their 49 hashes the middle 35 see equal neighbours only, and each ``NEAR`` of
these have a cut, so four cuts at least lie there and the first and the last are twenty words apart.

A window stays where it occurs first, in the order of id and place; later occurrences go, but never words of the first
one in the same text. A bitmap of the hashes that repeat, of fixed size, keeps most other windows from being shuffled;
what it lets through is counted exactly.

Defined cases: a null text stays null; rows of equal id and text count as one text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialised, written

NEAR, RUN_WORDS = 8, 20
#: Bits of the bitmap of repeated hashes, as a power of two.
BITMAP = 26
_WORD = re.compile(rf"[^{SPACE}]+")
_END = re.compile(rf"(?:[.!?] |\n)[{SPACE}]*")
_BLANKS = " \t\n\r\x0b\x0c"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashes(parts: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(p.encode("utf-8", "surrogatepass")) for p in parts), np.uint64, len(parts))


def joined(values: np.ndarray, first: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` values from ``first``."""
    owner = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    each = mixed(mixed(values ^ seed)[first[owner] + place] + (place.astype(np.uint64) + np.uint64(1)) * _ODD)
    out = np.zeros(len(first), np.uint64)
    np.add.at(out, owner, each)
    return mixed(out + size.astype(np.uint64) * seed)


def cuts_of(words: np.ndarray) -> np.ndarray:
    """Numbers of the words before which a piece ends; the text's ends are no cuts."""
    if len(words) < NEAR + 1:
        return np.empty(0, np.int64)
    pairs = mixed(words[:-1] * _ODD + mixed(words[1:]))
    around = np.lib.stride_tricks.sliding_window_view(pairs, NEAR)[:, ::-1]
    return np.unique(np.arange(len(around)) + NEAR - 1 - around.argmin(axis=1)) + 2


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, first character and end of each window."""
    ends = [m.end() for m in _END.finditer(text)]
    bounds = np.unique([0, *ends, len(text)]).tolist()
    lines = [(s, e, k) for s, e in zip(bounds, bounds[1:]) if (k := text[s:e].strip(_BLANKS))]
    kinds = []
    if len(lines) >= 3:
        at = np.arange(len(lines) - 2)
        starts, stops = np.array([x[0] for x in lines]), np.array([x[1] for x in lines])
        kinds.append((hashes([x[2] for x in lines]), at, np.full(len(at), 3), np.uint64(3), starts[at], stops[at + 2]))
    elif lines:
        one = np.array([0])
        kinds.append((hashes([text.strip(_BLANKS)]), one, one + 1, np.uint64(5), one, one + len(text)))
    spans = [m.span() for m in _WORD.finditer(text)]
    words = hashes([text[s:e] for s, e in spans])
    cuts = cuts_of(words)
    last = np.maximum(np.arange(len(cuts)) + 3, np.searchsorted(cuts, cuts + RUN_WORDS))
    first = np.flatnonzero(last < len(cuts))
    if len(first):
        lo, hi = cuts[first], cuts[last[first]]
        starts = np.array([s for s, _ in spans] + [len(text)])
        kinds.append((words, lo, hi - lo, np.uint64(7), starts[lo], starts[hi]))
    if not kinds:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h, g = (np.concatenate([joined(v, a, n, s ^ m) for v, a, n, s, _, _ in kinds]).view(np.int64) for m in (_ODD, _SECOND))
    return h, g, np.concatenate([k[4] for k in kinds]), np.concatenate([k[5] for k in kinds])


def repeated_bits(texts: DataFrame, text: str) -> np.ndarray:
    """A bit for each hash that occurs more than once, by its last ``BITMAP`` bits."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_h": np.concatenate([np.empty(0, np.int64), *[windows_of(t)[0] for t in batch[text]]])})

    repeated = texts.select(text).mapInPandas(found, "_h long").groupBy("_h").count().where("count > 1")
    bit = F.col("_h").bitwiseAND(F.lit((1 << BITMAP) - 1))
    parts = (
        repeated.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros((1 << BITMAP - 15, 1 << 12), np.uint8)
    for row in parts.collect():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its ``text`` cleaned."""
    digest = F.xxhash64(text).alias("_digest")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), digest, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(texts, "_text"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            rows, columns = [], []
            for n, t in enumerate(batch["_text"]):
                h, g, f, e = windows_of(t)
                low = h & ((1 << BITMAP) - 1)
                hit = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                rows.append(np.full(len(hit), n))
                columns.append((h[hit], g[hit], f[hit], e[hit]))
            if rows:
                of = batch[["_id", "_digest"]].iloc[np.concatenate(rows)].reset_index(drop=True)
                yield of.assign(**{c: np.concatenate(x) for c, x in zip(("_h", "_g", "_f", "_t"), zip(*columns))})

    kind = dict(docs.dtypes)[id_col]
    members = materialised(
        texts.mapInPandas(placed, f"_id {kind}, _digest long, _h long, _g long, _f int, _t int")
    )
    place = F.struct("_id", "_digest", "_f", "_t")
    first = members.groupBy("_h", "_g").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = members.join(written(first.drop("_n"), "first"), ["_h", "_g"]).where(~place.eqNullSafe(F.col("_first")))
    own = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_digest") == F.col("_first._digest"))
    later = later.withColumn("_f", F.when(own, F.greatest("_f", "_first._t")).otherwise(F.col("_f"))).where("_f < _t")
    spans = later.groupBy("_id", "_digest").agg(F.sort_array(F.collect_set(F.struct("_f", "_t"))).alias("_spans"))
    marked = docs.withColumn("_digest", F.xxhash64(text))
    same = marked[id_col].eqNullSafe(spans["_id"]) & (marked["_digest"] == spans["_digest"])
    cut = marked.join(spans.select("_id", "_digest", "_spans"), same, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(state, span):
        between = F.substring(F.col(text), state["at"] + 1, F.greatest(span["_f"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], span["_t"]).alias("at"), F.concat(state["kept"], between).alias("kept")
        )

    def finish(state):
        return F.concat(state["kept"], F.substring(F.col(text), state["at"] + 1, F.length(text)))

    cleaned = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.aggregate("_spans", start, step, finish))
    return cut.withColumn(text, cleaned).select(*docs.columns)
