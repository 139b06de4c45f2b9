import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from greenledger.llm import packing


def check_plan(counts, plan, capacity):
    seen = np.zeros_like(counts)
    for group in plan:
        assert sum(x * n for x, n in group.lengths) <= capacity
        for x, n in group.lengths:
            seen[x] += n * group.times
    assert (seen == counts).all()
    return sum(g.times for g in plan)


def fewest(lengths, capacity):
    """Brute force over all ways to put the lengths into sequences."""
    best = len(lengths)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        x = rest[0]
        for room in set(rooms):
            if room >= x:
                left = list(rooms)
                left.remove(room)
                go(rest[1:], [*left, room - x])
        go(rest[1:], [*rooms, capacity - x])

    go(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_as_short_as_brute_force(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 21, r.integers(1, 10))
    counts = np.bincount(lengths, minlength=21)
    plan, bound = packing.complete(counts, 20)
    assert bound <= check_plan(counts, plan, 20) == fewest(lengths.tolist(), 20)


def test_search_beats_best_fit():
    counts = np.bincount([6, 5, 5, 4, 4, 3, 3], minlength=11)  # best fit: 6+4, 5+5, 4+3+3
    assert check_plan(counts, packing.complete(counts, 10)[0], 10) == 3
    lengths = np.random.default_rng(4).integers(200, 520, 3000)
    counts = np.bincount(lengths, minlength=1025)
    plan, bound = packing.complete(counts, 1024)
    assert bound <= check_plan(counts, plan, 1024) <= check_plan(counts, packing.best_fit(counts, 1024), 1024)


def test_empty_plan():
    assert packing.complete(np.zeros(11, int), 10)[0] == []
    assert packing.places([]).shape == (0, 6)


def test_cut_points():
    assert packing.cut_points(5, 8) == [0, 5]
    assert packing.cut_points(8, 8) == [0, 8]
    assert packing.cut_points(17, 8) == [0, 1, 9, 17]
    assert packing.cut_points(24, 8) == [0, 8, 16, 24]


def test_pack_round_trip(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(docs).collect()
    assert [f for f in packing.pack(docs).columns] == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    ]
    want = []
    for row in docs.collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        at = packing.cut_points(len(ids), packing.CAPACITY)
        for piece, (a, b) in enumerate(zip(at, at[1:])):
            want.append((row["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [tuple(r)[:5] for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_pack_nothing(frame):
    assert packing.pack(frame([], "doc_id long, text string")).collect() == []


def test_many_equal_lengths(frame):
    rows = packing.pack(frame([(i % 50, "same words here") for i in range(600)], "doc_id long, text string")).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows) == 600
    assert len({r["sequence_id"] for r in rows}) == -(-600 // (1024 // rows[0]["length"]))
