"""Quality rules of documents, judged alone and by host.

A document fails by itself when it is too short or repeats itself. Failures are then counted per host; the failure
rate of each host is shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves, and the
verdict of a host applies to its documents. Everything is columns: the text is read once, in its scan, and only the
counts of a document move.

Defined cases: a null text has no words and fails; a null host takes part in no host statistic and gets no host
verdict; repeated rows count and return as often as they occur; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialised, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected when the shrunk share of its documents that fail is above this.
MAX_HOST_RATE = 0.5
#: Weight of the prior in documents, at least and at most.
PRIOR_WEIGHT = (1.0, 10000.0)


def shifted(array: Column, by: int, of: Column) -> tuple[Column, Column]:
    """An array without its last and without its first ``by`` elements; ``of`` is its size."""
    n = F.greatest(of - by, F.lit(0))
    return F.slice(array, F.lit(1), n), F.slice(array, F.lit(by + 1), n)


def add_window_hashes(df: DataFrame, tokens: str, window: int = WINDOW) -> DataFrame:
    """``h``: the hash of each window of ``window`` (a power of two) words, by doubling: h2, h4, h8."""
    df = df.withColumn("h", F.transform(tokens, lambda w: F.xxhash64(w)))
    width = 1
    while width < window:
        first, second = shifted(F.col("h"), width, F.size("h"))
        df = df.withColumn("h", F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def repeated_positions(h: Column) -> Column:
    """Sorted positions of the array elements that occur more than once."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    first, second = shifted(placed, 1, F.size(h))
    pairs = F.zip_with(first, second, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def covered(positions: Column, window: int = WINDOW) -> Column:
    """How many places windows at these sorted positions cover together."""
    first, second = shifted(positions, 1, F.size(positions))
    gaps = F.zip_with(first, second, lambda a, b: F.least(b - a, F.lit(window)))
    return F.aggregate(gaps, F.lit(window).cast("long"), lambda total, gap: total + gap)


def add_base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts of each text and ``base_failed``; the text itself is dropped."""
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda line: F.rlike(line, F.lit(f"[^{SPACE}]")))
    df = docs.withColumns({
        "word_chars": F.length(F.regexp_replace(plain, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
        "_lines": lines,
        "_words": words(F.col(text)),
    }).drop(text)
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    df = add_window_hashes(df, "_words").drop("_words")
    # Most texts repeat no window: only the others are sorted.
    df = df.withColumn("_repeated", F.size(F.array_distinct("h")) < F.size("h"))
    df = df.withColumn("_at", F.when(F.col("_repeated"), repeated_positions(F.col("h")))).drop("h", "_repeated")
    df = df.withColumn("n_repeat_words", F.coalesce(covered(F.col("_at")), F.lit(0).cast("long"))).drop("_at")
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """``host``, ``host_rate``: the failure rate of each host, shrunk by the beta prior of all hosts.

    The prior has the overall rate as its mean; its weight comes from the spread of the host rates beyond what
    sampling explains. Only five sums over the hosts reach the driver.
    """
    hosts = materialised(
        judged.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("_n"), F.count_if("base_failed").alias("_f"))
    )
    n, f, squares, count = hosts.agg(
        F.sum("_n"), F.sum("_f"), F.sum(F.col("_f") * F.col("_f") / F.col("_n")), F.count("*")
    ).first()
    rate, weight = prior(n or 0, f or 0, squares or 0.0, count)
    return hosts.select(host, ((F.col("_f") + rate * weight) / (F.col("_n") + weight)).alias("host_rate"))


def prior(n: int, f: int, squares: float, hosts: int) -> tuple[float, float]:
    """Mean and weight of the beta prior from the documents, failures, sum of f*f/n and number of hosts."""
    if n == 0:
        return 0.0, PRIOR_WEIGHT[0]
    rate = f / n
    spread = rate * (1 - rate)
    between = squares / n - rate * rate - spread * hosts / n
    weight = spread / between - 1 if between > 0 else PRIOR_WEIGHT[1]
    return rate, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def judge_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, ``host_rate`` and ``kept`` of each document."""
    judged = materialised(add_base_rules(docs, text))
    rates = host_rates(judged, host)
    rejected = F.coalesce(F.col("host_rate") > MAX_HOST_RATE, F.lit(False))
    return judged.join(rates, host, "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
