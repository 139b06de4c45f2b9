"""Removal of passages that repeat, by overlapping windows of three lines.

A line ends at a line break or after a sentence mark followed by a space, so that a passage set inside a paragraph has
lines of its own. Every three consecutive lines that hold a word form a window, however few words they have; the lines
of a text that has fewer than three form one window together, which repeats where another such text has the same lines.
Windows that occur more than once anywhere are kept where they occur first, in the order of id and place; the lines of
all later occurrences go, whether they belong to one window or to several that overlap.

Only the windows' hashes are shuffled, first to find the few that repeat; a window held by a third of all texts is
counted before it moves and then joined with a table of its own, so that Spark splits the join. Defined cases: a null
text stays null; a text without a word is left alone; the id of a row may be null (such rows come first) or repeated:
rows of equal id and text count as one text and are changed alike; an empty table gives an empty result; all other
columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialised, written

#: One line with the white space after it, so that only the first match of a text can be blank; the last is empty.
LINE = rf"(?s).*?(?:[.!?] |\n|\z)[{SPACE}]*"
WINDOW = 3
_ENDS = " \n\r\t"


def lines_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def over_windows(lines: Column, *salt: Column) -> Column:
    """A hash of each three neighbours, or of all lines where there are fewer."""

    def combine(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b, *salt)

    n = F.size(lines) - (WINDOW - 1)
    first, second, third = (F.slice(lines, F.lit(i), n) for i in (1, 2, 3))
    windows = F.zip_with(F.zip_with(first, second, combine), third, combine)
    return F.when(n > 0, windows).otherwise(F.array(F.xxhash64(lines, *salt)))


def hashed_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``_id``, ``_digest``, and the hashes of the lines that hold a word (``_lines``).

    Eight bytes a line are kept on the shared folder, so the texts are cut once for all that follows.
    """
    kept = F.filter(
        F.transform(lines_of(F.col(text)), lambda line: F.btrim(line, F.lit(_ENDS))),
        lambda line: F.rlike(line, F.lit(f"[^{SPACE}]")),
    )
    lines = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_digest"),
        F.transform(kept, lambda line: F.xxhash64(line)).alias("_lines"),
    )
    return materialised(lines.where(F.size("_lines") > 0))


def windows_of(lines: DataFrame, placed: bool = True) -> DataFrame:
    """``_id``, ``_digest``, ``_at`` (number of the window in its text), ``_h``, ``_g`` (two hashes of its lines' hashes),
    or only ``_h`` if not ``placed``."""
    first = over_windows(F.col("_lines")).alias("_h")
    if not placed:
        return lines.select(F.explode(first).alias("_h"))
    second = over_windows(F.col("_lines"), F.lit(1)).alias("_g")
    combined = lines.select("_id", "_digest", first, second)
    opened = combined.select("_id", "_digest", F.posexplode(F.arrays_zip("_h", "_g")).alias("_at", "_w"))
    return opened.select("_id", "_digest", "_at", "_w._h", "_w._g")


def later_occurrences(windows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per text the numbers of its windows that are not the first of their kind: ``_id``, ``_digest``, ``_removed``.

    ``hashes`` has ``_h`` of all windows once more, so that counting them does not carry their places.
    """
    repeated = written(hashes.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "repeated")
    # A hash of 64 bits may bring different windows together here; the second one keeps them apart.
    members = materialised(windows.join(repeated, "_h", "left_semi"))
    place = F.struct("_id", "_digest", "_at")
    first = written(members.groupBy("_h", "_g").agg(F.min(place).alias("_first")), "first")
    later = members.join(first, ["_h", "_g"]).where(~place.eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_digest").agg(F.sort_array(F.collect_set("_at")).alias("_removed"))


def covered_lines(removed: Column) -> Column:
    """The runs of lines, from and to, that windows at these sorted numbers cover, overlapping runs merged; the run of a
    text of fewer lines ends behind its last."""
    start = F.array().cast("array<struct<f:int,t:int>>")

    def merge(runs: Column, at: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["f"].alias("f"), (at + WINDOW - 1).alias("t"))))
        new = F.concat(runs, F.array(F.struct(at.alias("f"), (at + WINDOW - 1).alias("t"))))
        return F.when((F.size(runs) > 0) & (at <= last["t"] + 1), longer).otherwise(new)

    return F.aggregate(removed, start, merge)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its ``text`` cleaned, and ``removed_lines``: how many lines that hold a word were removed."""
    lines = hashed_lines(docs, id_col, text)
    later = later_occurrences(windows_of(lines), windows_of(lines, placed=False))
    removed = later.withColumn("_runs", covered_lines(F.col("_removed")))
    marked = docs.withColumn("_digest", F.xxhash64(text))
    same = marked[id_col].eqNullSafe(removed["_id"]) & (marked["_digest"] == removed["_digest"])
    joined = marked.join(removed.select("_id", "_digest", "_runs"), same, "left")
    # Lines are cut once per changed text, and only there; a blank start of the text is not numbered.
    cut = joined.withColumn("_lines", F.when(F.col("_runs").isNotNull(), lines_of(F.col(text))))
    cut = cut.withColumn("_blank", F.when(F.rlike(F.get("_lines", F.lit(0)), F.lit(f"[^{SPACE}]")), 0).otherwise(1))
    stays = F.filter("_lines", lambda line, i: ~F.exists(
        "_runs", lambda r: (r["f"] <= i - F.col("_blank")) & (i - F.col("_blank") <= r["t"])
    ))
    cut = cut.withColumn("_stays", stays)
    # The last line of the cut is empty: it is neither counted nor missed.
    count = (F.size(F.array_remove("_lines", "")) - F.size(F.array_remove("_stays", ""))).cast("long")
    cleaned = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join("_stays", ""))
    removed_lines = F.when(F.col("_runs").isNull(), F.lit(0).cast("long")).otherwise(count).alias("removed_lines")
    return cut.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns], removed_lines)
