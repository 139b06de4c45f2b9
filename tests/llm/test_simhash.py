import numpy as np
import pytest

from greenledger.llm import simhash
from greenledger.llm.components import connected

from .conftest import rows_of


def signed(values):
    return [int(v) for v in np.array(values, np.uint64).view(np.int64)]


def groups_by_brute_force(values, most):
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if int(a ^ values[j]).bit_count() <= most:
                parent[top(i)] = top(j)
    out = {}
    for i, v in enumerate(signed(values)):
        out.setdefault(top(i), set()).add(v)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("block", [512, 24])
def test_links_against_brute_force(frame, block):
    """Chains and dense groups whose members share frequent keys, compared in one block and in many."""
    r = np.random.default_rng(3)
    values = list(r.integers(0, 2**63, 20, dtype=np.uint64))
    for start in values[:3]:
        at = start
        for _ in range(80):
            new = at
            for bit in r.integers(0, 64, r.integers(1, 6)):
                new = new ^ np.uint64(1 << int(bit))
            values.append(new)
            at = new if r.random() < 0.3 else at
    values = list(np.unique(np.array(values, np.uint64)))
    prints = frame([(v,) for v in signed(values)], "fingerprint long")
    links = simhash.find_links(prints, block=block)
    assert links.count() < 16 * 64 * len(values)
    roots = {row["node"]: row["root"] for row in connected(links).collect()}
    found = {}
    for v in signed(values):
        found.setdefault(roots.get(v, v), set()).add(v)
    assert {frozenset(g) for g in found.values()} == groups_by_brute_force(values, 4)
    assert all(root == min(group) for root, group in found.items())


def test_fingerprint_cases():
    assert simhash.simhash(None) == simhash.simhash("") == simhash.simhash(" \n\x0b") == 0
    assert simhash.simhash("A b\tC") == simhash.simhash("a  b c")
    assert simhash.simhash("Ä") != simhash.simhash("ä")  # only A-Z is lowered
    many = "a b c d e " * 40_000  # longer than one block of hashes
    assert simhash.simhash(many) == simhash.simhash(many.upper())


def test_near_duplicates_cases(docs):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert len(got) == docs.count()
    # Empty texts are linked, the smallest id names them; the row without id belongs to them too.
    assert got.count((None, 1)) == 1 and (2, 1) in got and (3, 1) in got
    assert got.count((4, 4)) == 3 and (5, 4) in got


def test_keep_first_cases(docs, frame):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([1, 4, 4, 6, 7, None], key=repr)
    empty = frame([], "doc_id long, text string, _first int")
    assert simhash.keep_first(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []


def test_copies_share_one_node(frame):
    rows = [(i, "the very same words again and again") for i in range(500)] + [(1000, "something else altogether now")]
    marked = simhash.near_duplicates(frame(rows, "doc_id long, text string"))
    assert rows_of(marked.select("component_id").distinct(), "component_id") == [(0,), (1000,)]


def test_long_chain(frame):
    links = frame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = dict(rows_of(connected(links), "node", "root"))
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert connected(frame([], "a long, b long")).collect() == []
