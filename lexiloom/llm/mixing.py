"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source whose target exceeds its size is first taken whole, once per complete epoch; the rest of its target is drawn
without replacement: every document gets an exponential key whose rate is its quality weight, and documents are taken
in the order of their keys until the prefix sum of their sizes meets the budget. Keys come from a hash of the doc_id,
or of the text where there is none, so reruns agree. Rows of equal key, id and size are told apart by a number that
each row gets when it is written, so a source of repeated rows meets its target, too.

The prefix sums are taken over key ranges first; only the one range in which a source's budget runs out is sorted.
The ranges are 65,536 steps of the distribution that keys have at the least weight: of a weight of 1 the fullest range has
one row in 6,500, of 0.1 one in 65,000, so a source that holds a third of all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, md5_fraction

WEIGHTS, LIMIT, RANGES = (5, 2, 1), 3, 1 << 16
#: The least weight that ``quality_weight`` gives.
LEAST_WEIGHT = 0.1


def quality_weight(text) -> F.Column:
    """A document's weight, 0.1 to 1: the share of its characters that are letters, digits, blanks or common punctuation."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}0-9 \n.,]", ""))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(F.try_divide(plain.cast("double"), F.length(text).cast("double")), F.lit(0.0))


def mixture_targets(sources: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) -> plus target: weights repeat over the sources by code point, a missing source last.

    Together the targets are 100% of all sizes. None exceeds ``limit`` times its source's size: what would is given to
    the others by their weights, until none is above. That is filling all to one level per weight, which is found by
    taking the sources by the level at which each is full.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("w", w).withColumn("full", F.col("source_size") * float(limit) / F.col("w"))
    after = Window.orderBy("full", "rank").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(limit)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - spent) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    target = F.when(F.col("full") < F.col("level"), F.col("source_size") * float(limit)).otherwise(F.col("level") * F.col("w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, limit: int = LIMIT, weight=None) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source) with their columns, plus size, source_size, target and times.

    ``times`` is how often the mix takes the row: once per complete epoch, and once more if the draw picks it. Sizes
    count words; a missing text has none and is taken with its key like any other. The draw stops at the document that
    brings the source nearest to its target. Of rows that repeat each other as many are taken as are needed. Columns of
    ``docs`` with the added names are replaced; names that begin with _mix_ are kept for inner use and not allowed. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col("text").cast("string")
    docs = docs.drop("size", "source_size", "target", "times")
    size = F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    # The rarest draws come last: -ln(u) / weight.
    key = -F.log(md5_fraction(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))) / (weight if weight is not None else quality_weight(F.coalesce(text, F.lit(""))))
    if any(c.startswith("_mix_") for c in docs.columns):
        raise ValueError("columns whose names begin with _mix_ are kept for inner use")
    name = lambda c: f"_mix_{c}"
    rows = docs.withColumn("size", size).withColumn(name("key"), key)
    rows = scratch.save(rows.withColumn(name("range"), F.floor(RANGES * (1 - F.exp(-LEAST_WEIGHT * F.col(name("key"))))).cast("int")).withColumn(name("row"), F.monotonically_increasing_id()), "rows")
    sums = scratch.save(rows.groupBy(F.col("source").cast("string").alias("source"), F.col(name("range")).alias("range")).agg(F.sum("size").alias("size")), "sums")
    targets = mixture_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The range in which each source's budget runs out, and what is left of the budget there.
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.select("source", "range", "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    cut = targets.join(cut, targets["source"].eqNullSafe(cut["source"])).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left")))
    cut = cut.select(targets["source"], "range", (F.col("left") - F.col("before")).alias("budget"))
    cut = cut.groupBy("source").agg(F.min_by("budget", "range").alias("budget"), F.min("range").alias("range"))
    cut = scratch.save(cut.select(F.col("source").alias("cut_source"), "range", "budget"), "cut")
    last = rows.select(F.col("source").cast("string").alias("source"), "doc_id", "size", F.col(name("row")).alias("row"), F.col(name("key")).alias("key"), F.col(name("range")).alias("at"))
    last = last.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("at") == F.col("range"))) if _few(cut) else last.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("at") == F.col("range")))
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("row")]
    last = last.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Sizes before a document plus half its own: below the budget, taking it comes nearer to the target than leaving it.
    last = last.where(F.col("before") + F.col("size") / 2 <= F.col("budget")).groupBy("source").agg(F.max(F.struct(*[F.coalesce(F.col(c), F.lit(-(1 << 62))).alias(c) if c == "doc_id" else F.col(c) for c in ("key", "doc_id", "size", "row")])).alias("last"))
    plan = targets.join(cut, targets["source"].eqNullSafe(cut["cut_source"]), "left").drop("cut_source", "budget")
    plan = plan.join(last.select(F.col("source").alias("last_source"), "last"), plan["source"].eqNullSafe(F.col("last_source")), "left").drop("last_source")
    plan = scratch.save(plan.select(*[F.col(c).alias(name(f"plan_{c}")) for c in ("source", "source_size", "target", "epochs", "range", "last")]), "plan")
    p = lambda c: F.col(name(f"plan_{c}"))
    joined = rows.join(F.broadcast(plan) if _few(plan) else plan, rows["source"].cast("string").eqNullSafe(p("source")))
    own = F.struct(F.col(name("key")).alias("key"), F.coalesce("doc_id", F.lit(-(1 << 62))).cast("long").alias("doc_id"), F.col("size"), F.col(name("row")).alias("row"))
    drawn = F.col(name("range")) < p("range")
    drawn = drawn | ((F.col(name("range")) == p("range")) & F.coalesce(own <= p("last"), F.lit(False)))
    drawn = F.coalesce(drawn, F.lit(False))  # nothing runs out where the target is whole epochs
    return joined.select(*docs.columns, "size", p("source_size").alias("source_size"), p("target").alias("target"), (p("epochs") + drawn.cast("int")).alias("times"))


def _few(table: DataFrame, limit: int = 50_000) -> bool:
    """Whether a table has few enough rows to be sent to every executor."""
    return table.limit(limit + 1).count() <= limit
