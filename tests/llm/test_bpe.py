import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from greenledger.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def test_chunks_make_up_the_text():
    text = " ".join(f"Ünï çödé{i * i} ✓ \U0001f600 words" for i in range(300)).encode()
    parts = bpe.chunks(text, 4)
    assert b"".join(parts) == text and len(parts) > 100
    assert all(p.decode() for p in parts)  # no cut inside a character
    assert bpe.chunks(b"") == [] and bpe.chunks(b"a") == [b"a"]
    # A shared passage gives the same chunks after other beginnings.
    shared = b" ".join(b"word%d" % i for i in range(400))
    assert set(bpe.chunks(b"abc " + shared, 5)[3:-1]) <= set(bpe.chunks(b"other start " + shared + b" end", 5))


def test_joins_are_repaired(tokenizer, monkeypatch):
    """Every chunk with a middle comes from the table, whatever it cuts: words, marks, special strings."""
    monkeypatch.setattr(bpe, "chunks", lambda data, bits=2, cut=bpe.chunks: cut(data, 2))
    random.seed(5)
    pieces = [*"ab cd\n'sΣé́ \t1!", "<|endoftext|>", " ", "\n", "it's", "\x1c", " "]
    for _ in range(400):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 120)))
        table = {c: bpe.encode_text(bpe.bare(c)[1], bpe.TOKENIZER) for c in bpe.chunks(text.encode()) if bpe.bare(c)}
        got = bpe.encode(text, table)
        want = tokenizer.encode(text, add_special_tokens=False)
        assert got.ids == " ".join(map(str, want.ids)) and got.count == len(want.ids)
        assert got.tokens == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_documents(spark, docs, tokenizer):
    shared = " ".join(f"Passage{i % 91} of words{i}" for i in range(900))
    more = spark.createDataFrame([(100 + i, f"start {i} {shared} end{i}") for i in range(6)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    assert len(bpe.chunk_table(rows)) > 3
    texts = [r["text"] for r in rows.collect()]
    want = []
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((len(ids), " ".join(map(str, ids)), decoded))
    got = bpe.encode_documents(rows)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = bpe.encode_documents(rows, digests=True).collect()
    assert sorted(tuple(r)[1:] for r in digests) == sorted((n, sha(i), sha(d)) for n, i, d in want)


def test_no_documents(frame):
    assert bpe.encode_documents(frame([], "doc_id long, text string")).collect() == []


def test_words_leave_a_full_memory(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "WORD_MEMORY", 5)
    monkeypatch.setattr(bpe, "PART_MEMORY", 5)
    for start in range(0, 60, 20):
        words = [f"word{i}" for i in range(start, start + 20)] + ["x" * 200]
        want = tokenizer.encode(" ".join(words), add_special_tokens=False)
        assert bpe.encode_words(words, bpe.TOKENIZER).ids == " ".join(map(str, want.ids))
