"""Properties of code points as a table of ranges, from the sets that the segmenters use, and a join of text with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets as cs
from .graphemes import break_classes

#: Code points of a bin; a range is in all bins that it touches, so the table has some thousand rows, whatever the data.
BIN = 256


def property_sets() -> dict[str, set[int]]:
    """Code points by property: Latin letters by case, combining diacritics, and the break classes of graphemes."""
    return {"latin_letter": cs.points(cs.LATIN_RANGES), "latin_uppercase": cs.UPPER_POINTS, "latin_lowercase": cs.LOWER_POINTS, "combining_diacritic": cs.points("300-36F")} | break_classes()


def property_ranges() -> list[tuple[str, int, int]]:
    """(property, first, last) of the runs of code points in each set."""
    out: list[tuple[str, int, int]] = []
    for name, found in property_sets().items():
        for c in sorted(found):
            if out and out[-1][0] == name and out[-1][2] == c - 1:
                out[-1] = (name, out[-1][1], c)
            else:
                out.append((name, c, c))
    return out


def ranges_table(spark: SparkSession) -> DataFrame:
    """(property, first, last) as a table."""
    return spark.createDataFrame(property_ranges(), "property string, first int, last int")


def with_properties(rows: DataFrame, sign: Column | str) -> DataFrame:
    """Each row of ``rows`` once for each property that the first code point of ``sign`` has, in a new column ``property``.

    A join by bins of code points with the table of ranges. Missing and empty signs have no property.
    """
    table = ranges_table(rows.sparkSession)
    table = table.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor(F.col("last") / BIN))))
    sign = F.col(sign) if isinstance(sign, str) else sign
    point = F.when(sign != "", F.ascii(sign))
    found = rows.withColumn("_point", point).withColumn("_bin", F.floor(F.col("_point") / BIN))
    found = found.join(F.broadcast(table), "_bin").where(F.col("_point").between(F.col("first"), F.col("last")))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "property")
