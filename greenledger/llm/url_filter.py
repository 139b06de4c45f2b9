"""URL verdicts from host and path rules and a Bloom filter cascade.

A cascade answers membership exactly for every key of a known universe: level 0 is a Bloom filter of the listed
keys, level 1 one of the unlisted keys that pass level 0, level 2 one of the listed keys that pass level 1, and so
on until nothing passes wrongly. The levels are literals of the plan, so a table is judged in its scan, without a
join, a shuffle or Python.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is not listed; repeated
rows each get a row; an empty table, universe or list gives no listed key; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialised

BITS_PER_KEY = 12
HASHES = 6
#: All levels together travel in the plan, so their size is checked: 2^25 bits are 4 MB.
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``words`` are 64-bit words, ``bits`` a power of two."""

    seed: int
    bits: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        # Splitting a literal is folded by the optimizer, so this is one array constant however many words it has.
        text = F.lit(",".join(map(str, self.words)))
        words = F.split(text, ",").cast("array<bigint>")
        return F.forall(positions(key, self.seed, self.bits),
                        lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")),
                                           p.bitwiseAND(F.lit(63)).cast("int")) == 1)


def positions(key: Column, seed: int, bits: int) -> Column:
    """The bit positions of a key; ``bits`` is a power of two, so masking spreads evenly."""
    return F.array(*[F.xxhash64(key, F.lit(seed * HASHES + i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)])


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe the cascade was built over; false for null."""
        inside = F.lit(False)
        for level in reversed(self.levels):
            inside = level.passes(key) & ~inside
        return F.coalesce(inside, F.lit(False))


def encode(keys: DataFrame, seed: int, n: int) -> Level:
    """One level over ``n`` distinct keys. Its words are gathered: at most ``bits / 64`` of them."""
    bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())
    if bits > MAX_BITS:
        raise ValueError(f"a filter level of {n} keys takes {bits} bits, more than MAX_BITS; use a semi-join")
    place = F.explode(positions(F.col("key"), seed, bits))
    rows = (
        keys.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        # The exponent is a column, so that the shift is done for each row.
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set_bits"))
        .collect()
    )
    filled = [0] * (bits // 64)
    for row in rows:
        filled[row["word"]] = row["set_bits"]
    return Level(seed, bits, tuple(filled))


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """``universe`` and ``listed`` have a string column ``key``; listed keys outside the universe are harmless."""
    flagged = materialised(
        universe.select("key", F.lit(False).alias("listed"))
        .unionByName(listed.select("key", F.lit(True).alias("listed")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    levels: list[Level] = []
    members, others = flagged.where("listed"), flagged.where("not listed")
    while (n := members.count()) > 0:
        level = encode(members, len(levels), n)
        levels.append(level)
        members, others = others.where(level.passes(F.col("key"))), members
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule], value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits; of equally long ones the first in text order."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.lit(getattr(rule, value))).otherwise(chosen)
    return chosen


def labels_of(host: Column) -> Column:
    return F.split(host, r"\.")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url",
               keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict`` and ``listed`` of each row of ``pages``.

    ``listed`` (column ``key``) holds host labels; a host is listed if one of its labels is. Rules come first, then
    the list blocks, anything else is allowed. The universe is every label of every host of ``pages``.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    cascade = build_cascade(parts.select(F.explode(labels_of(F.col("host"))).alias("key")), listed)
    host, path = F.col("host"), F.col("path")
    return parts.withColumns({
        "rule": rule_for(host, path, rules, "text"),
        "listed": F.exists(labels_of(host), cascade.contains),
    }).withColumn(
        "verdict",
        F.coalesce(rule_for(host, path, rules, "verdict"), F.when(F.col("listed"), "block").otherwise("allow")),
    )
