import pytest

import corpus_pipeline

from .conftest import rows_of


def words(seed, n):
    return [f"w{(seed * 7919 + i * i * 31 + i) % 10_007}x{seed}" for i in range(n)]


@pytest.mark.parametrize("marks", [(), (30,)])
def test_passage_that_starts_and_ends_mid_line(spark, frame, marks):
    """Passages of no or one sentence end inside; the edges may stay, the middle goes."""
    shared = words(0, 60)
    for at in marks:
        shared[at] += "."
    rows = [(i, " ".join(words(i, 40) + shared + words(i + 50, 40))) for i in (1, 2, 3)]
    got = dict(rows_of(corpus_pipeline.line_deduplication(spark, frame(rows, "doc_id long, text string"), ""), "doc_id", "text"))
    assert got[1] == rows[0][1]
    for i in (2, 3):
        assert len(set(shared) & set(got[i].split())) <= 40
        assert got[i].split()[:40] == words(i, 40) and got[i].split()[-40:] == words(i + 50, 40)


def test_any_fifty_words_hold_a_run():
    from greenledger.llm import passages

    shared = words(0, 50)
    for i in range(1, 200):
        a, b = (passages.windows_of(" ".join(words(s, 30 + s % 9) + shared + words(s + 1, 30)))[0] for s in (i, i + 500))
        assert set(a.tolist()) & set(b.tolist())


def test_short_lines_and_short_texts(spark, frame):
    rows = [(1, "Own one here\nHome\nNews\nHelp\n"), (2, "Other two there\nHome\nNews\nHelp\n"), (3, "Same text"), (4, "Same text"),
            (5, "z " * 90), (6, None)]
    got = dict(rows_of(corpus_pipeline.line_deduplication(spark, frame(rows, "doc_id long, text string"), ""), "doc_id", "text"))
    assert got == dict(rows) | {2: "Other two there\n", 4: ""} | {5: got[5]}
    assert got[5].split().count("z") >= 20
