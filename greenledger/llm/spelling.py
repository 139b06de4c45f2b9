"""Spelling variants of words grouped under the frequent word they stand for, by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Of such a pair the shorter
word (of equally long ones the smaller) gives two disjoint chunks, its first half and the rest; the longer one gives
positional grams of both chunk lengths. One edit leaves a chunk whole: an edit behind the first half leaves that at its
place, any other leaves the rest, moved by the difference of the lengths, which is the shift of at most one. Grams at
other places cannot join and are not made, so a word gives at most six keys. Chunks and grams meet in one equality join,
whose condition first compares the sets of letters and then verifies the edit distance; only near pairs leave it.

Words are counted before they are shuffled, so a very common word is one row a task; a very common chunk meets its grams
in a join of two shuffled sides, which Spark splits. Forms are followed by doubling the steps, so a chain costs rounds
by the logarithm of its length.

Defined cases: a null or empty text has no words; a null id counts as an empty one in the hash; repeated rows count each
time; of equally frequent near words the smaller one in code-point order is the form; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialised

LETTERS = "[A-Za-zÀ-ÿ]"
#: Code points and occurrences a word must have.
MIN_LENGTH, MIN_COUNT = 6, 5
#: One code point goes from every run of a document whose hash this number divides.
NOISE = 199
#: How many times as frequent as a word its form must be.
RATIO = 5


def noisy(word: Column, id_text: Column, noise: int = NOISE) -> Column:
    """The word, or without the code point at ``h % length`` where ``noise`` divides the CRC-32 of ``id:word``."""
    h = F.crc32(F.concat(id_text, F.lit(":"), word))
    at = F.pmod(h, F.length(word)).cast("int")
    without = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % noise == 0, without).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``min_length`` code points that occur ``min_count`` times."""
    # Shorter runs give no word that is long enough, so they are not even cut out.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    # The built-in lower-casing is right, and faster, where every character is ASCII.
    ascii_only = F.octet_length("_run") == F.length("_run")
    lowered = found.select("_id", F.when(ascii_only, F.lower("_run")).otherwise(ascii_lower(F.col("_run"))).alias("_run"))
    words = lowered.select(noisy(F.col("_run"), F.col("_id"), noise).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_bits(word: Column) -> Column:
    """A bit for each letter (letters may share one); one edit changes two bits at most."""
    one = F.lit(1).cast("long")
    bits = F.transform(F.split(word, ""), lambda c: F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def chunk_keys(words: DataFrame) -> DataFrame:
    """``_key`` and ``_rest`` (whether the chunk is the second one) of the two chunks of each word."""
    half = F.expr("_size div 2")
    first = F.substring("word", F.lit(1), half)
    rest = F.substring(F.col("word"), half + 1, F.col("_size"))
    return words.select("*", F.posexplode(F.array(
        F.xxhash64(F.lit(0), "_size", first), F.xxhash64(F.lit(1), "_size", rest)
    )).alias("_rest", "_key"))


def gram_keys(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``_key`` of each gram of a word that may be a chunk of a word as long or shorter by one."""
    keys = []
    for shift in (0, 1):
        size = F.col("_size") - shift
        half = F.expr(f"(_size - {shift}) div 2")
        first = F.xxhash64(F.lit(0), size, F.substring("word", F.lit(1), half))
        rest = F.xxhash64(F.lit(1), size, F.substring(F.col("word"), half + shift + 1, F.col("_size")))
        keys += [F.when(size >= min_length, first), F.when(size >= min_length, rest)]
    return words.select("*", F.explode(F.array(*keys)).alias("_key")).where(F.col("_key").isNotNull())


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b`` of every two near words of ``word``, ``n``, each pair once."""
    marked = words.select("word", "n", F.length("word").alias("_size"), letter_bits(F.col("word")).alias("_bits"))
    chunks, grams = chunk_keys(marked).alias("x"), gram_keys(marked, min_length).alias("y")
    x, y = F.col("x.word"), F.col("y.word")
    ordered = (F.col("x._size") < F.col("y._size")) | (x < y)
    letters = F.bit_count(F.col("x._bits").bitwiseXOR(F.col("y._bits"))) <= 2
    # A code point between the chunks leaves both whole; such a pair counts by its first chunk only.
    half = F.expr("x._size div 2")
    both = (F.col("x._rest") == 1) & (F.col("x._size") < F.col("y._size")) & (
        F.substring(x, F.lit(1), half) == F.substring(y, F.lit(1), half)
    )
    near = (F.col("x._key") == F.col("y._key")) & ordered & letters & ~both & (F.levenshtein(x, y, 1) == 1)
    return chunks.join(grams, near).select(
        x.alias("a"), F.col("x.n").alias("n_a"), y.alias("b"), F.col("y.n").alias("n_b")
    )


def best_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``form``, ``n_near``, ``form_n`` of every word."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), "near")).alias("_best"))
    form_n = -F.col("_best.col1")
    return (
        words.join(best, "word", "left")
        .withColumn("_ok", form_n >= ratio * F.col("n"))
        .select("word", "n", F.when(F.col("_ok"), F.col("_best.near")).alias("form"),
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_ok"), form_n).alias("form_n"))
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` with ``root``, the last word on the way from form to form; a form is more frequent, so ways end."""
    ways = materialised(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        longer = ways.join(further, F.col("root") == F.col("_at"), "left")
        step = materialised(longer.select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        ))
        ways = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    return forms.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, noise: int = NOISE, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``docs``."""
    words = materialised(word_counts(docs, id_col, text, min_length, min_count, noise))
    forms = materialised(best_forms(words, near_pairs(words, min_length), ratio))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
