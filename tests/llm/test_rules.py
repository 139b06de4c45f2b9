import re
from collections import Counter

import pytest

from greenledger.llm import host_rules, url_filter

from .conftest import rows_of


def repeats(text, window=8):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    places = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i : i + window])] > 1:
            places |= set(range(i, i + window))
    return len(words), len(places)


@pytest.mark.parametrize("text", [
    None, "", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "q " + "a b c d e f g h i " * 3 + "z",
    "one two three four five six seven eight nine " + "k l m n o p q r s " * 2 + "one two three four five six seven eight",
])
def test_repeated_words(frame, text):
    got = host_rules.add_base_rules(frame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_words"], got["n_repeat_words"]) == repeats(text)


def test_counts(frame):
    text = "a#b\n\n$ % \n$ % \nÄ\U0001f600|\na#b"
    got = host_rules.add_base_rules(frame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == (7, 13, 7, 2)
    assert got["base_failed"]


def test_host_verdicts(frame):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, "short", "spam") for i in range(30)]
    rows += [(200, good, "spam"), (201, good, None), (202, "short", None), (203, good, "new")]
    got = {r["doc_id"]: r for r in host_rules.judge_documents(frame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["kept"] and not got[100]["kept"]
    assert not got[200]["base_failed"] and not got[200]["kept"]  # its host fails
    assert got[201]["kept"] and got[201]["host_rate"] is None and not got[202]["kept"]
    assert got[203]["kept"] and 0 < got[203]["host_rate"] < 0.5  # one good document does not make a host


def test_prior():
    assert host_rules.prior(0, 0, 0.0, 0) == (0.0, 1.0)
    assert host_rules.prior(10, 0, 0.0, 2) == (0.0, 10000.0)
    rate, weight = host_rules.prior(200, 100, 100.0, 2)  # one host always, one never
    assert rate == 0.5 and weight == 1.0


def test_documents_of_all_kinds(docs, frame):
    got = host_rules.judge_documents(docs)
    assert got.count() == docs.count()
    assert [r["n_words"] for r in got.where("doc_id = 1").collect()] == [0]
    assert host_rules.judge_documents(frame([], "doc_id long, text string, source string")).collect() == []


RULES = (
    url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("org", "/fr/", "allow"),
)


def test_urls(frame):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/de/", "x://net/",
        "http://net", "http://notnet.com/", "http://a.org/fr/?q=://b.net/", "http://bad.org/", "http://a.bad.org#/fr/",
        "http://good.org?x", "a://b.net:80/", "http://bad.org/", "http://A?B",
    ]
    pages = frame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' host", "1 key", "'y' verdict")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, RULES, frame([("bad",)], "key string")).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(4)] == [("", "")] * 4
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == (
        "www.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i]["rule"] for i in (5, 6, 7, 8, 9)] == ["net/", "net/", None, None, "org/fr/"]
    assert [got[i]["verdict"] for i in (5, 9, 10, 11, 12, 14)] == ["block", "allow", "block", "block", "allow", "block"]
    assert got[13]["host"] == "b.net:80" and got[13]["rule"] is None


def test_cascade_is_exact(spark):
    """Filters far too small for their keys, so that several levels are needed."""
    universe = spark.range(20_000).selectExpr("cast(id as string) as key")
    listed = universe.where("cast(key as int) % 7 = 0")
    bits = url_filter.BITS_PER_KEY
    try:
        url_filter.BITS_PER_KEY = 3
        cascade = url_filter.build_cascade(universe.unionByName(universe), listed.unionByName(listed))
    finally:
        url_filter.BITS_PER_KEY = bits
    assert len(cascade.levels) > 2
    found = universe.where(cascade.contains(universe["key"]))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0


def test_cascade_without_keys(frame):
    none = frame([], "key string")
    some = frame([("a",), (None,)], "key string")
    for universe, listed in ((none, none), (some, none)):
        cascade = url_filter.build_cascade(universe, listed)
        assert rows_of(some.select(cascade.contains(some["key"]).alias("x")), "x") == [(False,), (False,)]
