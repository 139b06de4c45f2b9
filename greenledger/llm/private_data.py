"""Personal data in texts: spans that exact patterns find, and further ones that weak labelers agree on.

The exact patterns give the base spans, which always stay. Looser patterns give candidates: written-out addresses,
numbers with other separators, colons or no plus sign. Seven small facts are noted of each base span and candidate: does
an exact pattern hold it, its inner structure (check digits, ranges, groups), gazetteers of its parts, cue words around
it, what it touches on either side, and whether other numbers stand near. Six labelers turn facts into votes for, against
or none. How many spans share a combination of facts is counted over all documents; there are at most ``CODES``
combinations, so the counts fit anywhere. Expectation-maximisation over them estimates, for each kind, how often a labeler
is right and how likely each combination is personal data, and a logistic regression over the facts is trained on these
likelihoods. Candidates it holds to be personal data, whose structure is sound and that touch no base span, are added.

Of each text only spans and fact codes leave the first pass, which are kept on the shared folder; fitting is some
thousands of numbers. Defined cases: a null or empty text has no spans; a null id stays null; repeated rows each get a
row; candidates that overlap give way to the earlier one, of equal start to the kind listed first; an empty table gives
an empty result; other columns are not read. All searches are linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Sizes of the facts of a span, the kind first; a code is their number in mixed radix.
SIZES = (4, 2, 3, 3, 3, 4, 4, 2)
CODES = int(np.prod(SIZES))
AGAINST, NONE, FOR = 0, 1, 2
#: Code points around a span that are searched for cue words, and for other numbers.
AROUND, CLOSE = 40, 12
#: The spans of a kind weigh as so many, however many there are, so that the same mixture gives the same verdicts at every
#: size; the belief that a span without any evidence is clean weighs as ``BELIEF`` of them.
WHOLE, BELIEF = 1000.0, 20.0
ROUNDS = 60

# Last parts of host names, prefixes of card numbers, country codes, cue words.
TOP_LEVELS = frozenset("com org net edu gov info biz io dev app de fr es it nl uk eu ch at be pl pt br us ca".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
COUNTRIES = re.compile(r"1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
CUES = (
    frozenset("mail email e-mail mailto contact write kontakt correo courriel".split()),
    frozenset("ip host server address login adresse client peer".split()),
    frozenset("card visa mastercard amex credit debit karte carte tarjeta".split()),
    frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono ruf".split()),
)
CONTRARY = frozenset("version release isbn issn order token sha hash chapter section figure build invoice".split())

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _NUMBER = re.compile("[0-9]"), re.compile("[0-9]+")
_AT = re.compile(r" ?[\[({]at[\])}] ?| at ")
_SPOKEN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}")
_DOT = re.compile(r" ?[\[({]dot[\])}] ?| dot |\.")
_LOOSE = (
    (IP, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[?\(?\.\)?\]?[0-9]{1,3}){2}(?![0-9.])")),
    (IP, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (CARD, re.compile(r"(?<![0-9])[0-9](?:[ ./_-]?[0-9]){11,18}(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ ./-])[0-9]{3,4}[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4})?(?![0-9])")),
)
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def in_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    return int(digits.lstrip("0")[:4] or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses. The run before each ``@`` is read backwards, so a long text without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        start = at
        while host and start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if host and start < at:
            yield EMAIL, start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the exact patterns find, by start and kind."""
    found = list(emails(text))
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text):
            parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
            for i in range(0, len(parts) - 3, 4):
                if all(in_byte(text[s:e]) for s, e in parts[i : i + 4]):
                    found.append((IP, parts[i][0], parts[i + 3][1]))
        for m in _DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
        for m in _PLUS.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((PHONE, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """What the looser patterns find clear of base spans and of each other, by start."""
    found = []
    for at in _AT.finditer(text):
        host = _SPOKEN_HOST.match(text, at.end())
        local = _LOCAL.search(text, max(0, at.start() - 64), at.start()) if host else None
        if local:
            found.append((EMAIL, local.start(), host.end()))
    if _DIGIT.search(text):
        found += [(kind, *m.span()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
    found = [c for c in found if c[0] != PHONE or 9 <= sum(map(str.isdigit, text[c[1] : c[2]])) <= 15]
    kept, taken, end = [], iter([*base, (0, len(text) + 1, len(text) + 1)]), 0
    nearest = next(taken)
    for kind, start, stop in sorted(found, key=lambda s: (s[1], s[0])):
        while nearest[2] <= start:
            nearest = next(taken)
        if start >= end and stop <= nearest[1]:
            kept.append((kind, start, stop))
            end = stop
    return kept


def structure(kind: int, raw: str) -> int:
    """Does the span hold together by itself?"""
    digits = "".join(c for c in raw if "0" <= c <= "9")
    if kind == EMAIL:
        last = _DOT.split(raw)[-1]
        return AGAINST if not (last.isalpha() and last.isascii() and len(last) > 1) else NONE if " at " in raw and " dot " not in raw else FOR
    if kind == IP:
        if ":" in raw:
            return FOR if raw.count(":") == 7 else NONE if any(c.isalpha() for c in raw) else AGAINST
        return FOR if all(map(in_byte, _NUMBER.findall(raw))) else AGAINST
    if kind == CARD:
        return FOR if luhn(digits) else AGAINST
    if len(set(digits)) < 3:
        return AGAINST
    groups = [len(g) for g in _NUMBER.findall(raw)]
    return FOR if raw.startswith("+") or groups[-3:] == [3, 3, 4] or raw.startswith("(") else NONE


def gazetteer(kind: int, raw: str) -> int:
    """Are its parts known ones?"""
    digits = "".join(c for c in raw if "0" <= c <= "9")
    if kind == EMAIL:
        return FOR if _DOT.split(raw)[-1].lower() in TOP_LEVELS else NONE
    if kind == IP:
        first = raw.split(":")[0] if ":" in raw else digits and _NUMBER.search(raw).group()
        return AGAINST if first in ("0", "255") else FOR if first in ("10", "172", "192", "2001", "fe80") else NONE
    if kind == CARD:
        return FOR if ISSUERS.match(digits) and 13 <= len(digits) <= 19 else NONE
    code = digits[2:] if digits.startswith("00") else digits if raw.startswith("+") else ""
    return NONE if not code else FOR if COUNTRIES.match(code) else AGAINST


def edge(c: str) -> int:
    """What a span touches: nothing or a space, punctuation, a sign of code, part of a word."""
    if not c or c.isspace():
        return 0
    return 3 if c.isalnum() or c == "_" else 2 if c in "\"'`/\\=#&<>@+" else 1


def facts(kind: int, start: int, end: int, text: str, strict: bool) -> int:
    """The code of a span's facts."""
    raw, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    around = {w.lower() for part in (before, after) for w in _WORDS.findall(part)}
    cue = FOR if around & CUES[kind] else AGAINST if around & CONTRARY else NONE
    numbers = bool(_DIGIT.search(before[-CLOSE:]) or _DIGIT.search(after[:CLOSE]))
    values = (kind, int(strict), structure(kind, raw), gazetteer(kind, raw), cue, edge(before[-1:]), edge(after[:1]), int(numbers))
    return int(np.ravel_multi_index(values, SIZES))


def votes(codes: np.ndarray) -> np.ndarray:
    """Votes (1, 0 for none, -1) of pattern, structure, gazetteer, cues, edges and neighbours, a row for each code."""
    _, strict, inner, listed, cue, left, right, numbers = np.unravel_index(codes, SIZES)
    edges = np.where((left == 3) | (right == 3) | ((left == 2) & (right == 2)), -1, np.where((left < 2) & (right < 2), 1, 0))
    return np.stack([strict, inner - 1, listed - 1, cue - 1, edges, -numbers], axis=1)


def estimate(ballots: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each row of votes to be personal data, and each labeler's rate of votes for it among (clean, private).

    Expectation-maximisation of a two-class model in which labelers are independent given the class and no vote says
    nothing. A labeler starts with two right votes of three in either class.
    """
    likely = 1 / (1 + np.exp(-ballots.sum(axis=1)))
    pro, con = ballots == 1, ballots == -1
    rates = np.zeros((2, ballots.shape[1]))
    for _ in range(rounds):
        for y, share in enumerate((1 - likely, likely)):
            weight = (share * counts)[:, None]
            yes, no = (weight * pro).sum(axis=0), (weight * con).sum(axis=0)
            rates[y] = (yes + 1 + y) / (yes + no + 3)
        private = (likely * counts).sum()
        odds = np.log((private + 1) / (counts.sum() - private + BELIEF))
        odds = odds + pro @ np.log(rates[1] / rates[0]) + con @ np.log((1 - rates[1]) / (1 - rates[0]))
        likely = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return likely, rates


def features(codes: np.ndarray) -> np.ndarray:
    """Indicator columns for the classifier: all facts but that of the exact pattern."""
    parts = np.unravel_index(codes, SIZES)[2:]
    columns = [np.ones((len(codes), 1))]
    for values, size in zip(parts, SIZES[2:], strict=True):
        columns.append(np.eye(size)[values])
    return np.concatenate(columns, axis=1)


def regress(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression on likelihoods, by Newton steps."""
    found = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        slope = rows.T @ (weight * (target - p)) - ridge * found
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(found))
        step = np.linalg.solve(curve, slope)
        found = found + step / max(1.0, np.abs(step).max() / 2)
    return found


@dataclass(frozen=True)
class Model:
    """``chance`` of each code to be personal data; ``rates`` of each kind as ``estimate`` gives them."""

    chance: np.ndarray
    rates: dict[int, np.ndarray]


def fit(codes: np.ndarray, counts: np.ndarray) -> Model:
    """From how often each combination of facts occurs. A kind that does not occur has chance zero, and so has a span
    whose own structure speaks against it: a wrong check digit or number range is no matter of opinion."""
    chance, rates = np.zeros(CODES), {}
    every = np.arange(CODES)
    kinds = np.unravel_index(codes, SIZES)[0]
    for kind in np.unique(kinds).tolist():
        own = kinds == kind
        weight = WHOLE * counts[own] / counts[own].sum()
        likely, rates[kind] = estimate(votes(codes[own]), weight)
        # A span without any evidence: no vote inside, spaces around.
        blank = np.ravel_multi_index((kind, 0, NONE, NONE, NONE, 0, 0, 0), SIZES)
        found = regress(features(np.append(codes[own], blank)), np.append(likely, 0.0), np.append(weight, BELIEF))
        of_kind = every[np.unravel_index(every, SIZES)[0] == kind]
        holds = np.unravel_index(of_kind, SIZES)[2] != AGAINST
        chance[of_kind] = holds / (1 + np.exp(-np.clip(features(of_kind) @ found, -30, 30)))
    return Model(chance, rates)


def digest_form(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


READ = (
    "base array<struct<kind:int,first:int,last:int>>, base_codes array<int>, "
    "extra array<struct<kind:int,first:int,last:int>>, extra_codes array<int>"
)


def read_spans(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col``, base spans and candidates of each text with the codes of their facts (``READ``)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["_text"]:
                value = value or ""
                base = base_spans(value)
                extra = candidates(value, base)
                out.append((base, [facts(*s, value, True) for s in base], extra, [facts(*s, value, False) for s in extra]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            as_rows = [[dict(zip(("kind", "first", "last"), s, strict=True)) for s in spans] for spans in columns[0]]
            extras = [[dict(zip(("kind", "first", "last"), s, strict=True)) for s in spans] for spans in columns[2]]
            yield batch[[id_col]].assign(base=as_rows, base_codes=columns[1], extra=extras, extra_codes=columns[3])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, F.col(text).alias("_text"))
    return rows.mapInPandas(read, f"`{id_col}` {kind}, {READ}")


def fit_on(read: DataFrame) -> Model:
    """The model of all spans of ``read_spans``; at most ``CODES`` counts reach the driver."""
    counted = read.select(F.explode(F.concat("base_codes", "extra_codes")).alias("code")).groupBy("code").count().collect()
    counted.sort(key=lambda r: r["code"])
    codes = np.array([r["code"] for r in counted], np.int64)
    return fit(codes, np.array([r["count"] for r in counted], np.int64))


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, counts of base spans by kind, ``base_sha256``, ``spans`` (base and added ones) and ``n_added``."""
    read = materialised(read_spans(docs, id_col, text))
    accepted = fit_on(read).chance >= 0.5

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for base, extra, codes in zip(batch["base"], batch["extra"], batch["extra_codes"], strict=True):
                base = [(s["kind"], s["first"], s["last"]) for s in base]
                added = [(s["kind"], s["first"], s["last"]) for s, code in zip(extra, codes, strict=True) if accepted[code]]
                counts = [sum(s[0] == kind for s in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(digest_form(base).encode()).hexdigest()
                out.append((*counts, digest, digest_form(base + added), len(added)))
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            found = pd.DataFrame(out, columns=names, index=batch.index)
            yield pd.concat([batch[[id_col]], found], axis=1)

    kind = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return read.select(id_col, "base", "extra", "extra_codes").mapInPandas(
        settle, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string, n_added long"
    )
