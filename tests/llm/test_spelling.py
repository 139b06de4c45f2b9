import re
import zlib
from collections import Counter

import pytest

from greenledger.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, noise=spelling.NOISE, least=5):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 6:
                seen[word] += 1
    return {w: n for w, n in seen.items() if n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 5 * n else None
        out[word] = [form, n, len(near), counts[form] if form else None]
    rows = set()
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n, near, form_n))
    return rows


def rows_set(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_all_pairs(frame):
    """Words over few letters, so that there are many near ones, of all lengths and counts."""
    import random

    dice = random.Random(7)
    words = ["".join(dice.choice("abé") for _ in range(dice.randint(6, 9))) for _ in range(400)]
    rows = [(i, " ".join(dice.choice(words) for _ in range(60))) for i in range(150)]
    rows += [(1000 + i, " ".join(dice.choice(words[:15]) for _ in range(200))) for i in range(30)]
    rows += [(None, words[0] + " 12" + words[1].upper()), (5, None), (6, "")] + rows[:20]
    for noise in (spelling.NOISE, 7):
        got = rows_set(spelling.group_variants(frame(rows, "doc_id long, text string"), noise=noise))
        assert got == plain(plain_counts(rows, noise))
        assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_edits_at_every_place(frame):
    """An inserted, deleted or replaced code point at every place of words of even and odd length."""
    words = {}
    for base in ("kitchen", "tailor", "çéleste"):
        words[base] = 400
        for i in range(len(base) + 1):
            words[base[:i] + "z" + base[i:]] = 5
            if i < len(base):
                words[base[:i] + "ÿ" + base[i + 1 :]] = 6
                words[base[:i] + base[i + 1 :]] = 7
    words = {w: n for w, n in words.items() if len(w) >= 6}
    pairs = spelling.near_pairs(frame(list(words.items()), "word string, n long"))
    got = [frozenset((r["a"], r["b"])) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chain_of_forms(frame):
    """Forms are followed to the last; ties of frequency go to the smaller word."""
    counts = [("marbles", 5), ("marblez", 25), ("marbzez", 125), ("murbzez", 625), ("murbzzz", 3125), ("xurbzzz", 3125)]
    forms = spelling.best_forms(frame(counts, "word string, n long"), spelling.near_pairs(frame(counts, "word string, n long")))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.with_roots(forms).collect()}
    assert got["marbles"] == ("marblez", "murbzzz") and got["murbzez"] == ("murbzzz", "murbzzz")
    assert got["murbzzz"] == (None, "murbzzz") and got["xurbzzz"] == (None, "xurbzzz")
    tied = [("parlour", 5), ("parlous", 30), ("parlouz", 30)]
    forms = spelling.best_forms(frame(tied, "word string, n long"), spelling.near_pairs(frame(tied, "word string, n long")))
    assert {r["word"]: r["form"] for r in forms.collect()}["parlour"] == "parlous"


@pytest.mark.parametrize("text", [None, "", "short a1b2c3 ×÷ ÀÉ"])
def test_no_words(frame, text):
    assert spelling.group_variants(frame([(1, text)], "doc_id long, text string")).collect() == []


def test_documents_of_all_kinds(docs, frame):
    got = rows_set(spelling.group_variants(docs))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == plain(plain_counts(rows))
    assert spelling.group_variants(frame([], "doc_id long, text string, word string")).collect() == []
