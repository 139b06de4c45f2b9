"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the words and word beginnings that go with the label in a bounded sample of labelled documents; how many
documents hold a term is counted over all documents. The examples of the sample form an inverted index in blocks that
keeps, for each term and block, the largest weight. A document is compared block by block in the order of the largest
cosine a block can hold, until no block left can change its nearest examples. Their labels, weighted by cosine and
shrunk to the share of toxic examples, give the score; their ids are its evidence.

Defined cases: a null text is an empty one; a text without terms has no neighbours and gets the toxic share of the
examples without terms; equal cosines go to the smaller example id; an example is never the neighbour of a text
equal to its own, so rows of equal text get equal scores whatever their ids; repeated rows each get a row; without labels every score is 0.5; an empty table gives an empty result; labels, language, source
and id are never inputs of a score; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised
from .labelled import fit_sample, held_out

#: Labelled documents in the index, at most.
EXAMPLES = 20_000
NEIGHBOURS = 15
BLOCK = 512
#: Blocks compared one by one; what the bounds then leave is compared in one sweep over the terms.
AHEAD = 3
#: Documents a term must be in, and the log-likelihood ratio it must reach: chance gives 15 once in 10^4 terms.
MIN_DOCUMENTS, MIN_RATIO = 3, 15.0
#: Vectors whose neighbours one task remembers.
MEMORY = 50_000
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the overall share in a score, in neighbours of cosine one.
PRIOR = 1.0
FOLDS, HELD_OUT = 5, 0

_LETTERS = re.compile(r"[^\W\d_]+")


def term_counts(text: str | None) -> Counter[str]:
    """How often each word of a text occurs, and each beginning (marked by ``*``) of its longer words."""
    counts = Counter(_LETTERS.findall((text or "").lower()))
    for word, n in list(counts.items()):
        for size in BEGINNINGS:
            if len(word) > size:
                counts[word[:size] + "*"] += n
    return counts


def pick_terms(sample: DataFrame, label: str, text: str) -> list[str]:
    """Terms that occur in a larger share of the label's documents, the largest log-likelihood ratio first."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            positive: Counter[str] = Counter()
            for value, y in zip(batch[text], batch[label], strict=True):
                found = term_counts(value).keys()
                seen.update(found)
                if y:
                    positive.update(found)
            if seen:
                yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "k": [positive[t] for t in seen]})

    totals = sample.agg(F.count("*"), F.sum(label)).first()
    documents, positive = totals[0], totals[1] or 0
    if not 0 < positive < documents:
        return []
    seen = (
        sample.mapInPandas(terms, "term string, n long, k long")
        .groupBy("term")
        .agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"))
        .where(F.col("n") >= MIN_DOCUMENTS)
    )
    n, k, share = F.col("n"), F.col("k"), positive / documents

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    ratio = 2 * (
        part(k, n * share) + part(n - k, n * (1 - share))
        + part(positive - k, (documents - n) * share)
        + part(documents - positive - n + k, (documents - n) * (1 - share))
    )
    chosen = seen.where(k > n * share).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    return [r["term"] for r in chosen.orderBy(F.desc("ratio"), "term").select("term").collect()]


def term_vectors(docs: DataFrame, terms: list[str], text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``terms`` (sorted numbers in the vocabulary) and ``counts`` of each row."""
    number = {t: i for i, t in enumerate(terms)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                sorted((number[t], n) for t, n in term_counts(value).items() if t in number) for value in batch[text]
            ]
            yield batch[list(keep)].assign(
                terms=[[i for i, _ in f] for f in found], counts=[[n for _, n in f] for f in found]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", terms array<int>, counts array<int>"
    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(vectors, schema)


@dataclass(frozen=True)
class BlockMaxIndex:
    """Examples in blocks of ``BLOCK``. ``largest[t, b]`` is the largest weight of term t in block b; the postings of
    t in b are ``slots`` and ``weights`` from ``starts[t, b]`` to ``starts[t, b + 1]``."""

    ids: np.ndarray
    texts: np.ndarray
    copies: dict[int, int]
    labels: np.ndarray
    idf: np.ndarray
    largest: np.ndarray
    starts: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    share: float
    share_without: float

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and cosines of the ``k`` nearest examples, equal ones by id."""
        bounds = weights @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.count_nonzero(bounds > 0)]
        slots = np.empty(0, np.int64)
        cosines = np.empty(0)
        for done, block in enumerate(order.tolist()):
            # Rounding may set a bound a little below a cosine it covers.
            if len(slots) == k and bounds[block] < cosines[-1] - 1e-9:
                break
            rest = done == AHEAD
            start, end = (0, self.largest.shape[1]) if rest else (block, block + 1)
            totals = np.zeros((end - start) * BLOCK)
            first, last = self.starts[terms, start], self.starts[terms, end]
            for i in np.flatnonzero(last > first).tolist():
                lo, hi = first[i], last[i]
                totals[self.slots[lo:hi] - start * BLOCK] += weights[i] * self.weights[lo:hi]
            if rest:
                totals.reshape(-1, BLOCK)[order[:done]] = 0
            least = cosines[-1] - 1e-9 if len(slots) == k else 1e-300
            if rest and len(totals) > k:
                least = max(least, np.partition(totals, -k)[-k] - 1e-9)
            hit = np.flatnonzero(totals >= least)
            slots = np.concatenate([slots, hit + start * BLOCK])
            cosines = np.concatenate([cosines, np.round(totals[hit], 12)])
            best = np.lexsort((self.ids[slots], -cosines))[:k]
            slots, cosines = slots[best], cosines[best]
            if rest:
                break
        return slots, cosines

    def score(self, terms: list[int], counts: list[int], own: int | None, known: dict) -> tuple[float, list[int]]:
        """Score and evidence of one document, whose text has the hash ``own``; ``known`` remembers what equal vectors
        have found."""
        if not len(terms):
            return float(self.share_without), []
        # Examples of this very text are left out, so as many more are asked for.
        wanted = NEIGHBOURS + self.copies.get(own, 0)
        key = (tuple(terms), tuple(counts), wanted)
        if key not in known:
            if len(known) > MEMORY:
                known.clear()
            numbers = np.array(terms, np.int64)
            known[key] = self.nearest(numbers, unit(np.array(counts, float), self.idf[numbers]), wanted)
        slots, cosines = known[key]
        other = np.flatnonzero(self.texts[slots] != own)[:NEIGHBOURS] if own is not None else slice(NEIGHBOURS)
        slots, cosines = slots[other], cosines[other]
        votes = (cosines * self.labels[slots]).sum() + PRIOR * self.share
        return float(votes / (cosines.sum() + PRIOR)), self.ids[slots].tolist()


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf
    return weights / np.sqrt((weights**2).sum())


def build_index(ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]],
                idf: np.ndarray, texts: np.ndarray | None = None) -> BlockMaxIndex:
    """Examples are put in the order of their heaviest term, so that a block holds similar ones.

    ``texts`` are hashes that tell which examples have the same text; without them each has its own, its id.
    """
    texts = ids if texts is None else texts
    weighted = [(t, unit(c, idf[t]) if len(t) else np.empty(0)) for t, c in vectors]
    heaviest = np.array([t[w.argmax()] if len(t) else -1 for t, w in weighted], np.int64)
    without = heaviest < 0
    toxic = labels.sum()
    share = (toxic + 0.5) / (len(ids) + 1)
    order = [i for i in np.lexsort((ids, heaviest)).tolist() if not without[i]]
    blocks = -(-len(order) // BLOCK)
    term = np.concatenate([np.empty(0, np.int64), *[weighted[i][0] for i in order]]).astype(np.int64)
    weight = np.concatenate([np.empty(0), *[weighted[i][1] for i in order]])
    slot = np.repeat(np.arange(len(order)), [len(weighted[i][0]) for i in order])
    by_term = np.lexsort((slot, term))
    term, weight, slot = term[by_term], weight[by_term], slot[by_term]
    largest = np.zeros((len(idf), blocks))
    np.maximum.at(largest, (term, slot // BLOCK), weight)
    cell = term * (blocks + 1) + slot // BLOCK
    starts = np.searchsorted(cell, np.arange(len(idf))[:, None] * (blocks + 1) + np.arange(blocks + 1))
    return BlockMaxIndex(
        ids[order], texts[order], dict(Counter(texts[order].tolist())), labels[order], idf, largest, starts, slot, weight, share,
        (labels[without].sum() + share) / (without.sum() + 1),
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "toxic", keep: tuple[str, ...] = (), examples: int = EXAMPLES) -> DataFrame:
    """``id_col``, ``keep``, ``score`` and ``evidence`` (ids of the nearest examples) of every row of ``docs``.

    The gathered index has at most ``examples`` vectors over all terms that go with the label in them.
    """
    sample = fit_sample(docs, labels, label, ~held_out(id_col, FOLDS, HELD_OUT), examples, id_col, text)
    sample = materialised(sample)
    terms = pick_terms(sample, label, text)
    kept = tuple(dict.fromkeys([id_col, *keep]))
    own = F.xxhash64(text).alias("_own")
    vectors = materialised(term_vectors(docs.select(*kept, *({text} - {*kept}), own), terms, text, (*kept, "_own")))
    documents = vectors.count()
    frequency = np.zeros(len(terms))
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[row["t"]] = row["count"]
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    got = term_vectors(sample.select("*", own), terms, text, (id_col, label, "_own")).toPandas()
    got = got.sort_values([id_col, label], kind="stable").drop_duplicates(id_col)
    pairs = [
        (np.array(t, np.int64), np.array(c, float)) for t, c in zip(got["terms"], got["counts"], strict=True)
    ]
    index = build_index(got[id_col].to_numpy(), got[label].to_numpy(float), pairs, idf, got["_own"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, known = shared.value, {}
        for batch in batches:
            out = [
                found.score(t, c, own, known)
                for own, t, c in zip(batch["_own"].tolist(), batch["terms"], batch["counts"], strict=True)
            ]
            yield batch[list(kept)].assign(score=[s for s, _ in out], evidence=[e for _, e in out])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in kept) + f", score double, evidence array<{kinds[id_col]}>"
    return vectors.mapInPandas(score, schema)
