"""Which labelled documents a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for ids whose CRC-32 (as text) leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``id_col``, ``text`` and ``label`` of at most ``rows`` labelled ids, the first ones in the order of a hash.

    ``usable`` says which ids may be learnt from. Null labels count as unlabelled; of contradicting labels of one id
    the smaller holds. The chosen ids are bounded by ``rows``, so they are sent to the documents, which stay in place.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(id_col)
        .agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(rows)
    )
    texts = docs.select(id_col, text)
    return texts.join(F.broadcast(chosen), id_col).withColumnRenamed("_label", label)
