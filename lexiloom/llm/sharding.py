"""Sharding by a minimax contiguous partition.

Rows with equal texts are an atomic group. Groups stand in one order, that of their digest, so their sizes form a
sequence that is cut into contiguous shards; the largest shard is as small as any such cut can make it. Its capacity
is found by search: a capacity is feasible if filling shards greedily, each with as many groups as fit, uses no more
shards than asked for. A check takes one step per shard, and each step looks up the last group whose prefix sum still
fits. Many capacities are checked at once, so a step is one aggregate over the table of prefix sums, filtered to the
stretches where the lookups end, which the file's statistics prune.

Prefix sums are taken within digest ranges of equal width and added up over the ranges, so no sort or window passes
through one task. A group of very many copies is split into parts by doc_id for numbering its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS, PROBES = 8, 48


def _lookup(prefix: DataFrame, limits: list[int], widest: int) -> list[int]:
    """For each limit the largest prefix sum up to it; the largest group bounds how far below it stands."""
    found = F.lit(False)
    lo, hi = None, None
    for x in sorted(set(limits)):  # stretches that overlap are one
        if hi is not None and x - widest <= hi:
            hi = x
            continue
        if hi is not None:
            found = found | F.col("upto").between(lo, hi)
        lo, hi = x - widest, x
    found = found | F.col("upto").between(lo, hi)
    row = prefix.where(found).agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"c{i}") for i, x in enumerate(limits)]).first()
    return [v if v is not None else 0 for v in row]


def _cuts(prefix: DataFrame, capacities: list[int], shards: int, total: int, widest: int) -> list[list[int]]:
    """Where greedy filling cuts, for each capacity."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        if all(x >= total for x in at):
            break
        at = _lookup(prefix, [x + c for x, c in zip(at, capacities, strict=True)], widest)
        for own, x in zip(cuts, at, strict=True):
            own.append(x)
    return cuts


def minimax_cuts(prefix: DataFrame, shards: int, total: int, widest: int, probes: int = PROBES) -> list[int]:
    """Ends of the shards, as prefix sums, for the smallest feasible capacity. prefix: (upto), the sums of whole groups."""
    lo, hi = max(-(-total // shards), widest), -(-total // shards) + widest  # hi is always feasible
    while lo < hi:
        step = max(1, (hi - lo) // probes)
        tried = sorted({*range(lo, hi, step)})
        ends = _cuts(prefix, tried, shards, total, widest)
        fits = next((i for i, e in enumerate(ends) if e[-1] >= total), None)
        lo, hi = (tried[-1] + 1, hi) if fits is None else (tried[fits - 1] + 1 if fits else lo, tried[fits])
    ends = _cuts(prefix, [hi], shards, total, widest)[0]
    return [*ends, *[total] * (shards - len(ends))]


def shard(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards are contiguous in digest order and their largest is as small as possible. A row's
    size is its text's UTF-8 bytes plus 1; a missing text has none, its checksum is that of an empty text, and it forms
    a group of its own kind. ``slot`` numbers a shard's rows from 0 by digest and then doc_id, missing ids first;
    repeated rows get neighbouring slots. An empty table gives an empty result. Columns to ``carry`` follow; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("")).alias("digest"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2).alias("part"),
        *[F.col(f"`{c}`").alias(f"_{c}") for c in carry],
    )
    rows = scratch.save(rows, "rows")
    parts = scratch.save(rows.groupBy("digest", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "parts")
    groups = parts.groupBy("digest").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).withColumn("range", F.substring("digest", 1, 3))
    ranges = groups.groupBy("range").agg(F.sum("bytes").alias("range_bytes"), F.sum("rows").alias("range_rows"))  # 4,097 at most
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select("digest", "range", "bytes", "rows", F.sum("bytes").over(within).alias("b"), F.sum("rows").over(within).alias("r"))
    groups = groups.join(F.broadcast(ranges), "range").select("digest", "bytes", (F.col("b") + F.col("bytes_before")).alias("upto"), (F.col("r") + F.col("rows_before") - F.col("rows")).alias("row_start"))
    groups = scratch.save(groups.sortWithinPartitions("upto"), "groups")
    total, widest = groups.agg(F.max("upto"), F.max("bytes")).first()
    ends = minimax_cuts(groups, shards, total, widest) if total else [0] * shards
    # The shard of a group is the first whose end it doesn't pass; a shard's first row is that of its first group.
    of = F.lit(shards - 1)
    for k in range(shards - 2, -1, -1):
        of = F.when(F.col("upto") <= ends[k], F.lit(k)).otherwise(of)
    placed = groups.select("digest", "row_start", of.cast("int").alias("shard"))
    base = placed.groupBy("shard").agg(F.min("row_start").alias("base"))
    placed = placed.join(F.broadcast(base), "shard").select("digest", "shard", (F.col("row_start") - F.col("base")).alias("slot0"))
    earlier = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("digest", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("part0"))
    parts = scratch.save(parts.join(placed, "digest").select("digest", "part", "shard", (F.col("slot0") + F.col("part0")).alias("slot0")), "placed")
    number = F.row_number().over(Window.partitionBy("digest", "part").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    out = rows.withColumn("number", number).join(parts, ["digest", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("number")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"`_{c}`").alias(c) for c in carry])
