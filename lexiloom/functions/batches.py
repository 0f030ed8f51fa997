"""Arrow functions that work on a few rows at a time, so that memory doesn't grow with the batches that Spark makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE = 1 << 18


#: Bytes of the batches that Spark hands over, which are held whole beside their results.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound on Arrow batches to ``BATCH`` bytes unless it is a lower number of bytes already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = (spark.conf.get(key, None) or "").removesuffix("b")
    if not given.isdigit() or int(given) not in range(1, BATCH + 1):
        spark.conf.set(key, str(BATCH))


def slices(*arrays: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Rows of the arrays in order, cut where the texts in the first one would pass ``SLICE`` bytes."""
    n = len(arrays[0])
    ends = np.cumsum(pc.fill_null(pc.binary_length(arrays[0]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield tuple(a.slice(at, stop - at) for a in arrays)
        at = stop
    if not n:
        yield arrays


def arrow_slices(returns) -> Callable:
    """Like ``F.arrow_udf`` for a function of arrays, the first of them texts, that gives a value for each row.

    Spark hands over batches of thousands of rows, and tokens take many times the room of their text, in Python as well
    as in the JVM; so the function is called, and its results are sent, for one slice after the other.
    """

    def of(f: Callable[..., pa.Array]):
        if f.__code__.co_argcount == 1:

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in batches:
                    for part in slices(batch):
                        yield f(*part)

            run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        else:

            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for batch in batches:
                    for part in slices(*batch):
                        yield f(*part)

            run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(returns)(run)

    return of


def joined_slices(returns) -> Callable:
    """The same for functions whose results take no more room than their texts: one result for a whole batch, so that
    several such functions of a query still share one exchange with Python."""

    def of(f: Callable[..., pa.Array]):
        def run(*arrays: pa.Array) -> pa.Array:
            return pa.concat_arrays([f(*part) for part in slices(*arrays)])

        return F.arrow_udf(returns)(run)

    return of
