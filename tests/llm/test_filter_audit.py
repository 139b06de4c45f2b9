import json
import random
from collections import Counter
from itertools import permutations

import pytest

from greenledger.llm import filter_audit
from greenledger.session import scratch_path

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, lang string"


def words(text):
    return "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ")


def fails(text):
    found = [w for w in words(text) if w]
    return {
        "A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def plain(rows, labels):
    """The report document by document, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, part in rows:
        failed = fails(text or "")
        failed["E"] = doc_id is not None and any(o is not None and o < doc_id and (t or "") == (text or "") for o, t, _ in rows)
        docs.append((part or "", doc_id, {f for f, bad in failed.items() if bad}))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[2]]
                redundant = sum(f in d[2] for d in gone)
                left = [d for d in left if f not in d[2]]
                gone += removed
                shapley[part, f] += len(removed)
                unique = sum(d[0] == part and d[2] == {f} for d in docs)
                out[part, "".join(order), step] = [
                    len(left), len(removed), redundant, unique, sum(d[1] in good for d in removed),
                    sum(d[1] in toxic for d in removed),
                ]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts():
    distinct = " ".join(f"w{i}" for i in range(120))
    return [
        "", "few words", distinct, distinct + " and", "same " * 120, "LOUD " * 100, distinct + " # mark", "a | b",
        distinct + " SHOUTING" * 8, "x y" * 60, "same " * 119 + "$", "　" + distinct, " \t\n", distinct.replace(" ", "\n"),
    ]


def rows_set(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def files(spark, frame, parts, schema=SCHEMA):
    path = scratch_path(spark, "audit-test")
    for rows in parts:  # a file after the other: a stream takes the older ones first
        frame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_against_plain_in_any_order_of_arrival(spark, frame, order):
    dice = random.Random(3)
    rows = [(i, dice.choice([*texts(), None]), dice.choice(["en", "de", None])) for i in range(90)]
    rows += [(None, "few words", "en"), (None, None, None), rows[0], rows[0], (rows[1][0], rows[1][1], "en")]
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    arriving = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=order == "falling")
    if order == "mixed":
        dice.shuffle(arriving)
    path = files(spark, frame, [arriving[i : i + 20] for i in range(0, len(arriving), 20)])
    got = filter_audit.audit_files(spark, path, frame(labels, "doc_id long, quality int, toxic int"), batches=5)
    assert rows_set(got) == plain(rows, labels)


def test_smaller_ids_retract(spark, frame):
    """Each file has a smaller id of the same text: the changes of every batch move one row."""
    path = files(spark, frame, [[(i, "few words", "en")] for i in (9, 5, 1)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    changes = filter_audit.counter_changes(stream, frame([], "doc_id long, quality int, toxic int"))
    counters = scratch_path(spark, "audit-test")
    filter_audit.keep_counters(changes, counters, scratch_path(spark, "audit-test"))
    batches = spark.read.parquet(counters).where("n <> 0").groupBy("batch").pivot("mask", [1, 17]).sum("n").orderBy("batch")
    assert [(r["1"], r["17"]) for r in batches.collect()] == [(1, None), (None, 1), (None, 1)]
    total = {(r["mask"], r["n"]) for r in filter_audit.read_counters(spark, counters).collect()}
    assert total == {(1, 1), (17, 2)}


def test_changes_of_one_text():
    """A batch in several chunks, copies on both sides of the smallest id, ids missing."""
    import pandas as pd

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value
            json.loads(value[0])

    state, total, big = State(), Counter(), 2**60
    arrivals = [
        [[("k", 1, "en", 0, 0, 3, False, big + 7, 2), ("o", 2, "en", 0, 0, 1, False, 5, 1)],
         [("k", 1, "de", 1, 0, 1, False, big + 7, 1), ("k", 1, "en", 0, 0, 4, False, big + 8, 1)]],
        [[("k", 1, "en", 0, 0, 2, True, 0, 2)]],
        [[("k", 1, "en", 0, 1, 5, False, big + 6, 1), ("k", 1, "en", 0, 0, 1, False, 2, 1), ("o", 2, "en", 0, 0, 1, False, 9, 1)]],
    ]
    for chunks in arrivals:
        frames = iter([pd.DataFrame(c, columns=filter_audit.COUNTS) for c in chunks])
        for out in filter_audit.change_counters((0,), frames, state):
            for row in out.itertuples(index=False):
                total[tuple(row)[:4]] += row.n
    assert {k: n for k, n in total.items() if n} == {
        ("en", 1, 0, 0): 3, ("en", 17, 0, 0): 7, ("de", 17, 1, 0): 1, ("en", 17, 0, 1): 5,
        ("en", 2, 0, 0): 1, ("en", 18, 0, 0): 1,
    }


def test_shards():
    """As many texts a shard at every size."""
    assert [filter_audit.shard_bits(n) for n in (0, 63, 64, 1000, 10**6, 10**10, 10**30)] == [0, 0, 1, 4, 14, 28, 48]


def test_documents_of_all_kinds(spark, docs, frame):
    path = scratch_path(spark, "audit-test")
    docs.write.parquet(path)
    labels = frame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert rows_set(filter_audit.audit_files(spark, path, labels)) == plain(rows, [(1, 1, 0), (6, 0, 1)])
    empty = scratch_path(spark, "audit-test")
    docs.limit(0).write.parquet(empty)
    assert filter_audit.audit_files(spark, empty, labels).collect() == []
