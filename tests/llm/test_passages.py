import re
from collections import Counter

import pytest

from greenledger.llm import licenses, line_dedup

from .conftest import rows_of

PASSAGE = ("The first line of a passage that is shared. Then comes a second line with more words. "
           "A third one follows it here. And a fourth line ends the whole passage.")


def clean(rows):
    """Brute force: lines, windows, first occurrences."""
    cut = {}
    for n, (i, text) in enumerate(rows):
        if text is not None:
            cut[n] = (i, text, re.findall(line_dedup.LINE.replace(r"\z", r"\Z"), text))
    seen, windows = {}, []
    for n, (i, text, lines) in cut.items():
        held = [k for k, line in enumerate(lines) if line.strip()]
        for at in range(max(len(held) - 2, min(len(held), 1))):
            w = "\n".join(lines[k].strip(" \n\r\t") for k in held[at : at + 3])
            place = ((i is not None, i or 0), text, at)
            windows.append((n, w, place, held[at : at + 3]))
            seen[w] = min(seen.get(w, place), place)
    gone = {}
    for n, w, place, lines in windows:
        if place != seen[w]:
            gone.setdefault(n, set()).update(lines)
    return [
        (i, None if t is None else "".join(x for k, x in enumerate(cut[n][2]) if k not in gone.get(n, ())))
        for n, (i, t) in enumerate(rows)
    ]


@pytest.mark.parametrize("rows", [
    [(1, f"Own start.\n{PASSAGE}\nOwn end."), (2, f"Other. {PASSAGE} Rest of it."), (3, "Nothing shared. At all. Here.")],
    [(5, PASSAGE), (4, PASSAGE), (None, PASSAGE)],
    [(1, f"{PASSAGE} {PASSAGE} {PASSAGE}")],
    [(1, f" \n\n{PASSAGE}\n\n \nx"), (2, f"\t{PASSAGE}")],
    [(1, "A. B. C. D. E. A. B. C."), (2, "A. B. C. D.")],
    [(1, None), (2, ""), (3, " "), (3, "One line only"), (4, "a\nb\nc"), (4, "a\nb\nc")],
    [(1, "One line"), (2, " \n One line \n"), (3, "One line\nand two"), (4, "One line\n\nand two\n"), (5, "x. y"), (6, "x. y")],
    [(1, "Menu\nHome\nLinks\nBody of one."), (2, "Another body.\nMenu\nHome\nLinks\n"), (3, "Menu\nHome")],
    [(1, f"{PASSAGE} x y. {PASSAGE[:90]}"), (2, f"q r s. {PASSAGE[45:]} t u v. {PASSAGE[:130]}")],
])
def test_repeats_against_brute_force(frame, rows):
    got = line_dedup.remove_repeats(frame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "text") == sorted(clean(rows), key=repr)


def test_passage_in_many_documents(frame):
    rows = [(i, f"Opening of number {i}. {PASSAGE} Closing of number {i}.") for i in range(300)]
    got = dict(rows_of(line_dedup.remove_repeats(frame(rows, "doc_id long, text string")), "doc_id", "text"))
    assert got[0] == rows[0][1]
    assert all(got[i] == f"Opening of number {i}. Closing of number {i}." for i in range(1, 300))


def test_line_dedup_keeps_columns_and_rows(docs, frame):
    got = line_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "removed_lines"] and got.count() == docs.count()
    assert line_dedup.remove_repeats(frame([], "doc_id long, text string, _at int")).collect() == []
    short = [(1, "One line"), (2, " \nOne line\n"), (3, "a. b"), (4, "a. b"), (5, "x\ny\nz\nw"), (6, "q\nx\ny\nz\n")]
    counted = line_dedup.remove_repeats(frame(short, "doc_id long, text string"))
    assert rows_of(counted, "doc_id", "removed_lines") == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 0), (6, 3)]
    same = line_dedup.remove_repeats(frame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string"))
    assert rows_of(same, "text", "removed_lines") == [(PASSAGE, 0)] * 2  # a row repeated whole counts as one text


def licenses_by_brute_force(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """Every run of words against every template, then the weightiest that do not overlap."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    pairs = list(zip(words, words[1:]))
    best = {}
    for name, template in templates.items():
        b = re.findall(r"[^\W_]+", template.lower())
        b = Counter(zip(b, b[1:]))
        for i in (i for i, pair in enumerate(pairs) if pair in b):
            run = Counter()
            for j in range(i, min(len(pairs), i + 2 * b.total())):
                run[pairs[j]] += 1
                shared = (run & b).total()
                dice = 2 * shared / (j - i + 1 + b.total())
                if dice >= threshold:
                    found = (-shared * dice, -dice, i, j + 2, name)
                    best[name, i] = min(best.get((name, i), found), found)
    chosen = []
    for m in sorted(best.values()):
        if all(m[3] <= c[2] or c[3] <= m[2] for c in chosen):
            chosen.append(m)
    return sorted(chosen, key=lambda m: m[2])


HEADER = licenses.TEMPLATES["Apache-2.0 header"]


@pytest.mark.parametrize("text, names", [
    (None, []), ("", []), ("word", []), ("two words", []), ("Released under the MIT License.", ["MIT"]),
    ("released UNDER the mit, license", ["MIT"]),
    ("intro\nThis work is licensed under the GNU General Public License, version 3.\nrest", ["GPL-3.0"]),
    ("Code of ours is Licensed under the Apache License, Version 2.0 and comes as it is.", ["Apache-2.0"]),
    ("import os\n# " + HEADER.replace(". ", ".\n# ") + "\ndef f(x): return x", ["Apache-2.0 header"]),
    ("Some words. " + HEADER[:-40] + " More. All rights reserved.", ["Apache-2.0 header", "Proprietary"]),
    ("All rights reserved. " * 2, ["Proprietary"] * 2), ("long prose without any notice of the license " * 60, []),
    ("Licensed under CC BY 4.0.\nAll rights reserved.", ["CC-BY-4.0", "Proprietary"]),
    ("Licensed under CC BY-NC 4.0. x Released under MIT license", ["CC-BY-NC-4.0"]),
])
def test_licenses_against_brute_force(text, names):
    got = licenses.Matcher().scan(text)
    assert [tuple(m) for m in got] == licenses_by_brute_force(text)
    assert [m.license for m in got] == names


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if " " in n])
def test_each_body_is_found_among_other_words(name):
    body = licenses.TEMPLATES[name].split()
    del body[len(body) // 2]
    got = licenses.Matcher().scan("x = 1 // " + "\n // ".join([*body, "some", "more", "code"]))
    assert [m.license for m in got] == [name] and -got[0].dice > 0.9


def test_license_runs_of_random_words():
    import random

    pick = random.Random(5)
    templates = {"p": "a b c a b d", "q": "a b", "r": "c a c a c a c", "s": "b c a b c d d a"}
    matcher = licenses.Matcher(templates, 0.7)
    for _ in range(300):
        text = " ".join(pick.choice("abcde") for _ in range(pick.randrange(40)))
        assert [tuple(m) for m in matcher.scan(text)] == licenses_by_brute_force(text, templates, 0.7)


def test_license_table(docs, frame):
    got = licenses.scan_licenses(docs)
    assert got.columns == ["doc_id", "license", "dice", "matches"] and got.count() == docs.count()
    assert got.where("license is not null or size(matches) > 0").count() == 0
    assert licenses.scan_licenses(frame([], "doc_id long, text string")).collect() == []
    found = licenses.scan_licenses(frame([(1, "x\nAll rights reserved.")], "doc_id long, text string")).first()
    assert (found["license"], found["dice"], found["matches"]) == ("Proprietary", 1.0, [("Proprietary", 1.0, 1, 4)])


def test_query_against_brute_force(spark):
    from greenledger.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    short = {n: t for n, t in licenses.TEMPLATES.items() if " " not in n}
    rows = queries.op4_licenses(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = licenses_by_brute_force(texts[r["doc_id"]], short)
        assert r["n_matches"] == len(found) and r["licenses"] == ", ".join(sorted({m[4] for m in found}))
        assert (r["license"], r["dice"]) == ((min(found)[4], round(-min(found)[1], 6)) if found else (None, 0.0))
