"""Best-fit packing of tokenised documents into sequences by bin completion.

Only how many pieces have which length matters to a packing, and lengths are at most the capacity. So the plan is made
from a table of at most ``capacity`` counts, whatever the corpus: fillings are chosen for the largest length left, each
as often as the counts allow, by branch and bound. The pieces then find their places in Spark: the i-th piece of a
length takes the i-th place the plan has for it.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed as often as they
occur; pieces of equal length are taken in the order of id, piece and checksum, so ties do not matter; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialised

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Fillings tried for one largest length, and lengths settled in the whole search, before the incumbent is kept.
MAX_FILLINGS = 8
MAX_NODES = 4000
#: Nodes between two completions by best fit.
COMPLETE_EVERY = 64
#: Texts with these take the reference tokenizer itself; for all others the same vocabulary runs as ranks, which is
#: about three times as fast: special strings, white space beyond ASCII, letters newer than either rule set.
UNUSUAL = re.compile(r"<\||[^\u0000-ɏ‐-‧€]|[\x1c-\x1f\x85\xa0]")


@cache
def reference_tokenizer(name: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def fast_tokenizer(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, name: str = TOKENIZER) -> list[int]:
    text = text or ""
    if UNUSUAL.search(text):
        return reference_tokenizer(name).encode(text, add_special_tokens=False).ids
    return fast_tokenizer(name).encode_ordinary(text)


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces and the end: only the first may be shorter than the capacity."""
    if length <= capacity:
        return [0, length]
    return [0, *range(length % capacity or capacity, length + 1, capacity)]


def tokenised_pieces(docs: DataFrame, id_col: str, text: str, capacity: int, name: str = TOKENIZER) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each piece of each document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch[id_col].array, batch[text], strict=True):
                ids = np.array([*token_ids(value, name), END_ID], "<u4")
                at = cut_points(len(ids), capacity)
                rows += [
                    (None if pd.isna(key) else key, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))
                    for piece, (start, end) in enumerate(zip(at, at[1:], strict=False))
                ]
            frame = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32"])
            frame[id_col] = frame[id_col].astype("Int64" if id_kind == "bigint" else object)
            yield frame

    id_kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {id_kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text).mapInPandas(cut, schema)


# --- the plan -------------------------------------------------------------------------------------------------------


@dataclass
class Group:
    """``times`` sequences filled alike: ``lengths`` as (length, how many), largest first."""

    times: int
    room: int
    lengths: list[tuple[int, int]] = field(default_factory=list)


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best-fit decreasing on counts: each length goes where the least room is left, equal sequences together."""
    groups: list[Group] = []
    by_room: dict[int, list[Group]] = {}
    rooms = np.zeros(capacity + 1, np.int64)  # groups by room

    def put(group: Group) -> None:
        groups.append(group)
        by_room.setdefault(group.room, []).append(group)
        rooms[group.room] += 1

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            open_rooms = np.flatnonzero(rooms[length:])
            if len(open_rooms):
                room = int(open_rooms[0]) + length
                group = by_room[room].pop()
                rooms[room] -= 1
                groups.remove(group)
            else:
                room, group = capacity, Group(left, capacity)
            each = room // length
            full, rest = divmod(min(left, group.times * each), each)
            for times, many in ((full, each), (1 if rest else 0, rest)):
                if times:
                    put(Group(times, room - many * length, [*group.lengths, (length, many)]))
            used = full + bool(rest)
            if group.times > used and room < capacity:
                put(Group(group.times - used, room, group.lengths))
            left -= full * each + rest
    return groups


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """The larger of the bound by volume and, over all thresholds, by what cannot share with long pieces."""
    lengths = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * lengths)
    bound = -(-int(volume[capacity]) // capacity)
    half = capacity // 2
    for small in range(1, half + 1):
        alone = int(number[capacity] - number[capacity - small])
        paired = int(number[capacity - small] - number[half])
        middle = int(volume[half] - volume[small - 1])
        free = paired * capacity - int(volume[capacity - small] - volume[half])
        bound = max(bound, alone + paired + max(0, -(-(middle - free) // capacity)))
    return bound


def fillings(counts: np.ndarray, room: int, most: int) -> list[list[tuple[int, int]]]:
    """Undominated sets of lengths for ``room``, the fullest first, at most ``most`` of them.

    A set is dominated if one of its lengths can be exchanged for a larger one on hand that still fits, if two of them
    can be exchanged for one on hand of their sum, or if another length still fits. Lengths are tried from the largest,
    so the first perfect set is found early and ends the search.
    """
    on_hand = np.flatnonzero(counts[: room + 1])
    found: list[tuple[int, list[int]]] = []
    visits = 0

    def undominated(chosen: list[int], left: int) -> bool:
        spare = counts.copy()
        for x in chosen:
            spare[x] -= 1
        if left and (spare[1 : left + 1] > 0).any():
            return False
        if left and any((spare[x + 1 : x + left + 1] > 0).any() for x in set(chosen)):
            return False
        return not any(
            a + b < len(spare) and spare[a + b] > 0 for i, a in enumerate(chosen) for b in chosen[i + 1 :]
        )

    def extend(chosen: list[int], left: int, top: int) -> bool:
        """True once the search may end."""
        nonlocal visits
        visits += 1
        fitting = on_hand[: np.searchsorted(on_hand, min(left, top), "right")][::-1]
        if not len(fitting):
            if undominated(chosen, left):
                found.append((left, chosen))
            return left == 0 or len(found) >= most or visits > 50 * most
        # A single length that fills the room dominates every other set.
        for x in fitting[:8].tolist():
            if chosen.count(x) < counts[x] and extend([*chosen, x], left - x, x):
                return True
        return False

    extend([], room, room)
    if not found:
        found.append((room, []))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return [[(x, chosen.count(x)) for x in dict.fromkeys(chosen)] for _, chosen in found[:most]]


def complete(counts: np.ndarray, capacity: int, max_nodes: int = MAX_NODES) -> tuple[list[Group], int]:
    """A plan with as few sequences as the search finds, and the lower bound it is held against.

    Best fit gives the first incumbent. While it is above the bound, the search takes the largest length left, tries
    its undominated fillings, the fullest first, each as often as the counts allow, completes the rest by best fit for
    a new incumbent, and leaves a branch once its wasted room is more than a better plan could have.
    """
    counts = counts.astype(np.int64)
    bound = least_sequences(counts, capacity)
    best = best_fit(counts, capacity)
    best_size = sum(g.times for g in best)
    volume = int((counts * np.arange(capacity + 1)).sum())
    nodes = 0
    stack: list[tuple[np.ndarray, list[Group], int]] = [(counts, [], 0)]
    while stack and best_size > bound and nodes < max_nodes:
        left, made, waste = stack.pop()
        if waste > (best_size - 1) * capacity - volume:
            continue
        lengths = np.flatnonzero(left)
        done = sum(g.times for g in made)
        if not len(lengths):
            if done < best_size:
                best, best_size = made, done
            continue
        nodes += 1
        if nodes % COMPLETE_EVERY == 0:
            rest = best_fit(left, capacity)
            if (size := done + sum(g.times for g in rest)) < best_size:
                best, best_size = [*made, *rest], size
        top = int(lengths[-1])
        rest_counts = left.copy()
        rest_counts[top] -= 1
        branches = []
        for filling in fillings(rest_counts, capacity - top, MAX_FILLINGS):
            need = dict(filling)
            need[top] = need.get(top, 0) + 1
            times = min(int(left[x]) // n for x, n in need.items())
            room = capacity - sum(x * n for x, n in need.items())
            after = left.copy()
            for x, n in need.items():
                after[x] -= n * times
            group = Group(times, room, sorted(need.items(), reverse=True))
            branches.append((after, [*made, group], waste + room * times))
        stack.extend(reversed(branches))
    return best, bound


def places(plan: list[Group]) -> np.ndarray:
    """Rows (length, first rank, how many, per sequence, first sequence, offset), sorted by length and rank.

    Ranks of one length are dealt to its rows in turn, so the rows are as many as the plan's lengths, not the pieces.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for group in plan:
        offset = 0
        for length, many in group.lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, many * group.times, many, sequence, offset))
            taken[length] = rank + many * group.times
            offset += length * many
        sequence += group.times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece with its ``sequence_id`` and ``offset``."""
    session = docs.sparkSession
    pieces = materialised(tokenised_pieces(docs, id_col, text, capacity))
    # At most `capacity` rows: the counts of the lengths.
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan, _ = complete(counts, capacity)
    # Its size is bounded by the capacity: at most 2 * capacity groups of at most 44 different lengths each.
    slots = session.sparkContext.broadcast(places(plan))

    # A frequent length is dealt over buckets, which are ranked apart and put after each other.
    buckets = max(16, int(session.conf.get("spark.sql.shuffle.partitions")))
    order = (id_col, "piece", "ids_crc32", "start")
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    window_rows = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.expr("sum(_n) over (partition by length order by _bucket rows between unbounded preceding and 1 preceding)")
    first = window_rows.select("length", "_bucket", F.coalesce(before, F.lit(0)).cast("long").alias("_first"))
    within = F.expr(
        f"row_number() over (partition by length, _bucket order by `{id_col}`, piece, ids_crc32, start)"
    )
    ranked = (
        dealt.withColumn("_within", within)
        .join(first, ["length", "_bucket"])
        .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_within") - 1).alias("_rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = slots.value
        starts = rows[:, 0] * (1 << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("_rank").to_numpy()
            at = np.searchsorted(starts, length * (1 << 44) + rank, "right") - 1
            sequence, slot = np.divmod(rank - rows[at, 1], rows[at, 3])
            yield batch.assign(sequence_id=rows[at, 4] + sequence, offset=rows[at, 5] + slot * length)

    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != "_rank") + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)
