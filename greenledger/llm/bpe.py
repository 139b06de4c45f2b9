"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the bytes cuts every text where its last 16 bytes say so, so passages that texts share give the
same chunks wherever they stand. The chunks that repeat most are encoded once, by Spark, into a table whose size is
bounded; every other stretch of text is encoded in place, so the table saves work and never decides the result. A chunk
ends anywhere, also inside a word. Where a chunk from the table meets its neighbours, the text from the last separator
before the join to the first one after it is encoded again; at a separator both readings agree, because the tokenizer
never looks across a space or a line break.

Defined cases: a null text is an empty one, with no ids and an empty decoded text; repeated rows each get a row; a text
without separators is encoded as one word, whatever its length; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Chunks of the table and bytes of one of them, at most; both bound what is sent to the workers.
TABLE_CHUNKS = 8192
CHUNK_BYTES = 4096
#: A cut falls on every 2^CUT_BITS-th byte on average.
CUT_BITS = 9
#: Words, and parts of words, that one worker learns before it forgets those not seen since, and the longest of them.
WORD_MEMORY, PART_MEMORY, WORD_CHARS = 120_000, 200_000, 64
#: Words of Latin letters and then ASCII marks, without apostrophes: the tokenizer lowers the letters one by one and
#: never joins them with the marks, so both parts are encoded by themselves and remembered for other words.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

# One pseudo-random number per byte value (a Weyl sequence, mixed).
_GEAR = np.arange(1, 257, dtype=np.uint32) * np.uint32(2654435769)
_GEAR ^= _GEAR >> np.uint32(15)
_GEAR *= np.uint32(2246822519)
_GEAR ^= _GEAR >> np.uint32(13)


def chunks(data: bytes, cut_bits: int = CUT_BITS) -> list[bytes]:
    """Pieces of a UTF-8 text that together are the text; cuts depend on the 16 bytes before them only."""
    codes = np.frombuffer(data, np.uint8)
    rolling = _GEAR[codes]
    for step in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, each shifted by its distance
        if len(rolling) > step:
            longer = rolling.copy()
            longer[step:] += rolling[:-step] << np.uint32(step)
            rolling = longer
    at = np.flatnonzero(rolling >> np.uint32(32 - cut_bits) == 0) + 1
    at = at[at < len(codes)]
    at = at[codes[at] & 0xC0 != 0x80].tolist()  # never inside a character
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)] if data else []


@cache
def tokenizer(name: str) -> Tokenizer:
    # Spark has a task for each core already; threads of the library would only get in each other's way.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


@dataclass(frozen=True)
class Encoded:
    """Ids in decimal and tokens, each joined by spaces."""

    ids: str
    tokens: str
    count: int


class Memory:
    """Encodings by word. When ``size`` new ones are in, those asked for since stay and the others are forgotten later."""

    def __init__(self) -> None:
        self.new: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def age(self, size: int) -> None:
        if len(self.new) > size:
            self.old, self.new = self.new, {}

    def fetch(self, words: Iterable[str]) -> list[str]:
        """Make what is known of ``words`` new again; returns the others."""
        missing = []
        for word in words:
            if (found := self.old.get(word)) is not None:
                self.new[word] = found
            else:
                missing.append(word)
        return missing


_words: dict[str, Memory] = {}
_parts: dict[str, Memory] = {}


def encode_each(words: list[str], name: str) -> list[tuple[str, str]]:
    """Ids and tokens of each word by itself."""
    found = tokenizer(name).encode_batch(words, add_special_tokens=False)
    return [(" ".join(map(str, e.ids)), " ".join(e.tokens)) for e in found]


@cache
def merges(name: str):
    """The merging part of the tokenizer, which takes bytes as visible characters, and the characters of the bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return tokenizer(name).model, {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


def encode_plain(part: str, name: str) -> tuple[str, str]:
    """Ids and tokens of small Latin letters or of ASCII marks: one run, which only has to be merged."""
    model, signs = merges(name)
    found = model.tokenize(part.translate(signs))
    return " ".join([str(t.id) for t in found]), " ".join([t.value for t in found])


def encode_missing(words: list[str], name: str) -> list[tuple[str, str]]:
    """Ids and tokens of each word, plain words by their parts."""
    memory = _parts.setdefault(name, Memory())
    memory.age(PART_MEMORY)
    known = memory.new
    cut = [PLAIN.fullmatch(w) if len(w) <= WORD_CHARS else None for w in words]
    whole = [w for w, m in zip(words, cut, strict=True) if not m]
    others = dict(zip(whole, encode_each(whole, name), strict=True)) if whole else {}
    out = []
    for word, parts in zip(words, cut, strict=True):
        if not parts:
            out.append(others[word])
            continue
        pairs = []
        for part in (parts[1].lower(), parts[2]):
            if part:
                if (pair := known.get(part)) is None:
                    pair = known[part] = memory.old.get(part) or encode_plain(part, name)
                pairs.append(pair)
        a, b = pairs[0], pairs[-1]
        out.append(a if len(pairs) == 1 else (f"{a[0]} {b[0]}", f"{a[1]} {b[1]}"))
    return out


def encode_words(words: list[str], name: str) -> Encoded:
    """The encoding of the words one after another; a word is what stands between spaces and line breaks."""
    memory = _words.setdefault(name, Memory())
    memory.age(WORD_MEMORY)
    known = memory.new
    missing = memory.fetch(w for w in dict.fromkeys(words) if w not in known)
    extra = {}
    if missing:
        for word, pair in zip(missing, encode_missing(missing, name), strict=True):
            (known if len(word) <= WORD_CHARS else extra)[word] = pair
    pairs = [known[w] for w in words] if not extra else [extra.get(w) or known[w] for w in words]
    ids = " ".join([i for i, _ in pairs if i])
    return Encoded(ids, " ".join([t for i, t in pairs if i]), ids.count(" ") + 1 if ids else 0)


def encode_text(data: bytes, name: str) -> Encoded:
    return encode_words([w for w in data.decode().replace("\n", " ").split(" ") if w], name)


def bare(data: bytes) -> tuple[bytes, bytes, bytes] | None:
    """A chunk as the part up to its first separator, the part up to its last, and the rest; None without one."""
    first = min((i for i in (data.find(b" "), data.find(b"\n")) if i >= 0), default=-1)
    if first < 0:
        return None
    last = max(data.rfind(b" "), data.rfind(b"\n"))
    return data[:first], data[first : last + 1], data[last + 1 :]


def encode(text: str | None, table: dict[bytes, Encoded], name: str = TOKENIZER) -> Encoded:
    """The encoding of a text: middles of known chunks from ``table``, everything between them anew."""
    parts: list[Encoded] = []
    pending: list[bytes] = []
    for chunk in chunks((text or "").encode("utf-8", "replace")):
        middle = table.get(chunk)
        if middle is None:
            pending.append(chunk)
            continue
        head, _, tail = bare(chunk)
        pending.append(head)
        parts += [encode_text(b"".join(pending), name), middle]
        pending = [tail]
    parts.append(encode_text(b"".join(pending), name))
    parts = [p for p in parts if p.count]
    return Encoded(" ".join([p.ids for p in parts]), " ".join([p.tokens for p in parts]), sum(p.count for p in parts))


def repeated_chunks(docs: DataFrame, text: str, most: int) -> set[int]:
    """Hashes of the chunks that repeat, those that save most bytes first, at most ``most``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(c for t in batch[text] for c in table_chunks(t))
            if not seen:
                continue
            yield pd.DataFrame({
                "hash": np.fromiter(map(chunk_hash, seen), np.int64, len(seen)),
                "n": np.fromiter(seen.values(), np.int64, len(seen)),
                "bytes": np.fromiter(map(len, seen), np.int64, len(seen)),
            })

    counted = docs.select(text).mapInPandas(count, "hash long, n long, bytes long")
    best = counted.groupBy("hash").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).where("n > 1")
    best = best.orderBy(F.desc(F.col("bytes") * (F.col("n") - 1)), "hash").limit(most)
    return {r["hash"] for r in best.select("hash").collect()}


def chunk_hash(chunk: bytes) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(chunk)
    return value - (value >> 63 << 64)


def table_chunks(text: str | None) -> Iterable[bytes]:
    """The chunks of a text that may be in the table: short enough, and with something between two separators."""
    for chunk in chunks((text or "").encode("utf-8", "replace")):
        if len(chunk) <= CHUNK_BYTES and (parts := bare(chunk)) and len(parts[1]) > 1:
            yield chunk


def chunk_table(docs: DataFrame, text: str = "text", name: str = TOKENIZER, most: int = TABLE_CHUNKS) -> dict[bytes, Encoded]:
    """The middles of the chunks that repeat most, each encoded once; at most ``most`` of ``CHUNK_BYTES`` bytes.

    Chunks whose hash is taken by another one are all in the table: it is asked by the bytes themselves.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(repeated_chunks(docs, text, most))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for batch in batches:
            new = {c for t in batch[text] for c in table_chunks(t) if chunk_hash(c) in wanted.value} - done
            done |= new
            if new:
                yield pd.DataFrame({"chunk": sorted(new)})

    def encode_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [encode_text(bare(c)[1], name) for c in batch["chunk"]]
            yield batch.assign(ids=[e.ids for e in found], tokens=[e.tokens for e in found], n=[e.count for e in found])

    picked = docs.select(text).mapInPandas(pick, "chunk binary").distinct()
    rows = picked.mapInPandas(encode_once, "chunk binary, ids string, tokens string, n long").toPandas()
    return {bytes(c): Encoded(i, t, n) for c, i, t, n in rows.itertuples(index=False)}


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = TOKENIZER,
                     digests: bool = False) -> DataFrame:
    """``keep``, ``n_tokens``, and ``ids`` (in decimal, joined by spaces) and ``decoded``, or their SHA-256."""
    table = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, text, name))

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode()).hexdigest()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[text]:
                e = encode(value, table.value, name)
                rows.append((e.count, sha(e.ids), sha(e.tokens)) if digests else (e.count, e.ids, e.tokens))
            out = pd.DataFrame(rows, columns=["n_tokens", *names])
            yield pd.concat([batch[list(keep)].reset_index(drop=True), out], axis=1)

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", n_tokens long, {names[0]} string, {names[1]} string"
    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(work, schema)
