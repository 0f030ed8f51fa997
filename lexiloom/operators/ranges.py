"""Joins of byte ranges of the same text: graphemes in tokens, tokens in sentences or in any other spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a bin. A range meets a join partner in the bin of the inner range's start, so each pair is found once.
BIN = 128


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], bin_bytes: int = BIN) -> DataFrame:
    """Rows of ``outer`` (keys, offset, len, others), each with every row of ``inner`` (keys, offset, len, others) that lies within.

    Columns: those of ``outer``, and those of ``inner`` other than the keys with ``inner_`` before their names. An equi-join
    by keys and bins of offsets: an outer range goes to all bins that it touches, an inner one to that of its start, which
    holds as many ranges as a bin can, however long the text is. Empty ranges lie in a range around or at their place.
    Missing keys, offsets and lengths match nothing.
    """
    named = inner.select(*keys, *[F.col(f"`{c}`").alias(f"inner_{c}") for c in inner.columns if c not in keys])
    named = named.withColumn("_bin", F.floor(F.col("inner_offset") / bin_bytes))
    last = F.col("offset") + F.col("len")
    rows = outer.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("offset") / bin_bytes), F.floor(last / bin_bytes))))
    within = (F.col("inner_offset") >= F.col("offset")) & (F.col("inner_offset") + F.col("inner_len") <= last)
    return rows.join(named.hint("merge"), [*keys, "_bin"]).where(within).drop("_bin")
