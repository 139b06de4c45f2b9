import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from greenledger.llm import private_data as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for place, d in enumerate(map(int, digits[::-1])):
        total += sum(map(int, str(2 * d))) if place % 2 else d
    return total % 10 == 0


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def named(spans):
    return [(pii.KINDS[k], s, e) for k, s, e in spans]


def test_base_spans_are_those_of_the_patterns():
    dice = random.Random(5)
    pieces = ["@", ".", "a", "b-c", "%", "+", "1", "22", "255", "256", "007", " ", "-", "(", ")", "4111111111111111", "é", "\n",
              "x@y.z", "1.2.3.4", "+1 (017) 555-7713", "4111 1111 1111 1111", "..", "@@", "0" * 12]
    seen = Counter()
    for _ in range(20_000):
        text = "".join(dice.choice(pieces) for _ in range(dice.randint(1, 14)))
        assert named(pii.base_spans(text)) == plain_base(text), text
        seen.update(s[0] for s in plain_base(text))
    assert min(seen[k] for k in pii.KINDS) > 100


@pytest.mark.parametrize("text", ["a" * 300_000, "a." * 200_000, "1" * 300_000, "1." * 200_000, "@" * 200_000, "+1" + " " * 300_000,
                                  "+" * 200_000, "(at)" * 100_000, "ab:" * 100_000, "1 at a.b " * 40_000, "a@" * 150_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.time() - start < 5


def test_candidates_stand_clear_of_base_spans():
    text = "call 555 123 4567 or +1 (017) 555-7713, jo (at) mail (dot) example (dot) com, 10[.]0[.]0[.]7, 4111.1111.1111.1111"
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert [(k, text[s:e]) for k, s, e in named(found)] == [
        ("phone", "555 123 4567"), ("email", "jo (at) mail (dot) example (dot) com"), ("ip", "10[.]0[.]0[.]7"),
        ("card", "4111.1111.1111.1111"),
    ]
    both = sorted((s, e) for _, s, e in base + found)
    assert all(a[1] <= b[0] for a, b in zip(both, both[1:]))


def test_codes_are_bounded_and_turn_into_votes():
    every = np.arange(pii.CODES)
    assert pii.CODES == 6912 and set(np.unique(pii.votes(every))) == {-1, 0, 1}
    text = "tel 555 123 4567 now"
    code = pii.facts(pii.PHONE, 4, 16, text, False)
    assert pii.votes(np.array([code])).tolist() == [[0, 1, 0, 1, 1, 0]]
    assert pii.votes(np.array([pii.facts(pii.CARD, 6, 22, "token=4111111111111112x", False)])).tolist() == [[0, -1, 1, -1, -1, 0]]


def plain_estimate(rows):
    """Expectation-maximisation span by span; ``rows`` is one list of votes per span."""
    likely = [1 / (1 + math.exp(-sum(r))) for r in rows]
    for _ in range(pii.ROUNDS):
        rates = []
        for y in (0, 1):
            share = [p if y else 1 - p for p in likely]
            yes = [sum(w for w, r in zip(share, rows) if r[j] == 1) for j in range(6)]
            no = [sum(w for w, r in zip(share, rows) if r[j] == -1) for j in range(6)]
            rates.append([(a + 1 + y) / (a + b + 3) for a, b in zip(yes, no)])
        private = sum(likely)
        prior = math.log((private + 1) / (len(rows) - private + pii.BELIEF))
        likely = []
        for r in rows:
            odds = prior
            for j, v in enumerate(r):
                if v:
                    odds += math.log(rates[1][j] / rates[0][j] if v == 1 else (1 - rates[1][j]) / (1 - rates[0][j]))
            likely.append(1 / (1 + math.exp(-odds)))
    return likely, rates


def test_estimate_against_plain_and_recovers_reliabilities():
    dice = np.random.default_rng(11)
    truth = dice.random(4000) < 0.6
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.6, 0.55])
    cast = np.where(dice.random((4000, 6)) < right, truth[:, None], ~truth[:, None])
    ballots = np.where(dice.random((4000, 6)) < 0.2, 0, np.where(cast, 1, -1))
    patterns, which, counts = np.unique(ballots, axis=0, return_inverse=True, return_counts=True)
    likely, rates = pii.estimate(patterns, counts.astype(float))
    slow, slow_rates = plain_estimate(ballots.tolist())
    assert np.allclose(likely[which.reshape(-1)], slow) and np.allclose(rates, slow_rates)
    assert np.abs(rates[1] - right).max() < 0.05 and np.abs(1 - rates[0] - right).max() < 0.06
    known = math.log(0.6 / 0.4) + ballots @ np.log(right / (1 - right))  # the best rule, which knows the reliabilities
    assert ((likely[which.reshape(-1)] >= 0.5) == truth).mean() > ((known >= 0) == truth).mean() - 0.005


def corpus(n):
    rows = []
    for i in range(n):
        rows.append((4 * i, f"Please mail jo{i}@mail{i % 9}.example.com or call +1 (0{i % 90:02}) 555-{i % 10_000:04} today, from 10.0.0.{i % 250}"))
        rows.append((4 * i + 1, f"nothing {i} here; version 1.{i}.2, look at item.{i} or at once.more"))
        if i % 4 == 0:
            rows.append((4 * i + 2, f"contact ann{i} (at) mail (dot) example (dot) org soon, phone (555) 123-{i % 10_000:04} ok"))
            rows.append((4 * i + 3, f"order 4111-1111-1111-{i % 9000:04} sha 12_{i}"))
    return rows


def test_labelers_add_spans(frame):
    rows = corpus(120)
    got = {r["doc_id"]: r for r in pii.find_private_data(frame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, r in got.items():
        base = plain_base(texts[i])
        form = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(form.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, form.split(","))) <= set(r["spans"].split(","))
        added = [s.split(":") for s in r["spans"].split(",") if s and s not in form.split(",")]
        assert r["n_added"] == len(added)
        found = {k: texts[i][int(s) : int(e)] for k, s, e in added}
        if i % 4 == 2:
            n = i // 4
            assert found == {"email": f"ann{n} (at) mail (dot) example (dot) org", "phone": f"(555) 123-{n % 10_000:04}"}
        else:
            assert found == {}


def test_same_mixture_same_verdicts(frame):
    """Every span five times as often: the counts decide by their shares."""
    codes = pii.read_spans(frame(corpus(80), "doc_id long, text string"), "doc_id", "text")
    counted = codes.selectExpr("explode(concat(base_codes, extra_codes)) c").groupBy("c").count().collect()
    own, n = np.array([r["c"] for r in counted]), np.array([r["count"] for r in counted])
    once, often = pii.fit(own, n), pii.fit(own, 5 * n)
    assert np.allclose(once.chance, often.chance)


def test_documents_of_all_kinds(docs, frame):
    got = pii.find_private_data(docs)
    assert got.count() == docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["base_sha256"], r["spans"]) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(empty, "")}
    assert pii.find_private_data(frame([], "doc_id long, text string, base string")).collect() == []
    ids = frame([("x", "a@b.cd"), (None, "a@b.cd"), ("x", "a@b.cd")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["spans"]) for r in pii.find_private_data(ids).collect()) == [
        ("", "email:0:6"), ("x", "email:0:6"), ("x", "email:0:6"),
    ]
