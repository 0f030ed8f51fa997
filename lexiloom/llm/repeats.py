"""What the two repeat removers share: finding fixed-length windows of a sequence that occur more than once.

A document is a sequence of units (words or bytes). Every window of W units has an anchor: a symbol inside the
window that the window's content alone determines, so equal windows have equal anchors at the same offset.
Neighbouring windows mostly share one, so an occurrence (anchor, offset, first window, number of windows) stands for many.

1. Occurrences with equal anchors and equal content are a class. Where a class has several members, its windows are
   repeated, and only one member has to be looked at any more.
2. Classes with the same anchor and different content may share some of their windows. Anchors with few classes are
   solved in a task each. Where there are many, occurrences are split by the anchor's offset in the window, and windows
   whose offsets fall into one interval share a longer stretch, which is the key of a new, smaller bucket. Parts of
   equal content are a class again and leave as one run. Intervals narrow down to single windows, of which all that
   are left under one key are equal.

Every step aggregates on hashed keys with partial sums, so a passage in a third of all rows is no hot task: no group
is ever gathered. Text moves only for the documents that step 2 has to look at and for the final cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix

OCCURRENCE = "sym long, ctx long, off int, doc_id long, tid long, first int, n int"
#: Bytes of text that are worked on at once; a longer document is taken alone.
CHUNK = 1 << 18

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum with wrapping arithmetic."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n, _MULT, np.uint64)
        inverse = np.full(n + 1, _INVERSE, np.uint64)
        power[:1] = inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def range_argmin(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest value in each [lo, hi), the leftmost of equal ones, by a table of doubling spans."""
    best = np.arange(len(values))
    out = np.zeros(len(lo), np.int64)
    span, k = 1, 0
    size = hi - lo
    top = int(size.max(initial=0))
    while span <= top:
        now = (size >= span) & (size < 2 * span)
        if now.any():
            x, y = best[lo[now]], best[hi[now] - span]
            out[now] = np.where(values[y] < values[x], y, x)
        if 2 * span <= top:
            x, y = best[:-span], best[span:]
            best = np.where(values[y] < values[x], y, x)
        span, k = 2 * span, k + 1
    return out


def chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK bytes together."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > CHUNK:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def occurrence_batch(sym, ctx, off, doc, tid, first, n) -> pa.RecordBatch:
    """off: how far into the first window the anchor stands."""
    small = lambda x: pa.array(x.astype(np.int32))
    cols = [pa.array(sym.view(np.int64)), pa.array(ctx.view(np.int64)), small(off), pa.array(doc), pa.array(tid), small(first), small(n)]
    return pa.RecordBatch.from_arrays(cols, ["sym", "ctx", "off", "doc_id", "tid", "first", "n"])


def _later(rule: str):
    """Whether a member of a class repeats the class's least member by the rule."""
    return {"any": F.lit(True), "earlier": F.struct("doc_id", "first") > F.struct("least.doc_id", "least.first"), "earlier_doc": F.col("doc_id") > F.col("least.doc_id")}[rule]


def find_repeats(docs: DataFrame, occurrences: Callable, compare: Callable[[DataFrame, Scratch], DataFrame], rule: str, scratch: Scratch) -> DataFrame:
    """(doc_id, tid, spans): the repeated windows of each document as an array of (first, n).

    docs: doc_id, tid (a hash of the text), text. rule: ``any`` (it also starts anywhere else), ``earlier`` (it also
    starts earlier, by doc_id and position) or ``earlier_doc`` (it also starts in a document with a smaller doc_id).
    compare: given the members of the classes to compare (sym, doc_id, tid, first, n, off) and the documents,
     returns the windows among them that are repeated by the rule (doc_id, tid, first, n).
    """
    occ = scratch.save(docs.where("doc_id is not null").mapInArrow(occurrences, OCCURRENCE), "occurrences")
    cls = occ.groupBy("sym", "ctx").agg(F.min(F.struct("doc_id", "first", "tid", "n", "off")).alias("least"), F.count("*").alias("copies"))
    cls = scratch.save(cls, "classes")
    # A class alone with its anchor needs no comparison.
    by_sym = cls.groupBy("sym").agg(F.count("*").alias("k"), F.min("least.doc_id").alias("lo"), F.max("least.doc_id").alias("hi"))
    shared = scratch.save(by_sym.where("k > 1 and hi > lo" if rule == "earlier_doc" else "k > 1").select("sym"), "shared")
    several = scratch.save(cls.where("copies > 1").select("sym", "ctx", "least"), "several")
    members = scratch.save(occ.join(several, ["sym", "ctx"]), "members")
    later = _later(rule)
    covered = members.where(later).select("doc_id", "tid", "first", "n")
    # First members, and those that the rule doesn't call later although they aren't first.
    rest = cls.select("sym", "least.*").unionByName(members.where(~later & (F.struct("doc_id", "first") > F.struct("least.doc_id", "least.first"))).select("sym", "doc_id", "first", "tid", "n", "off"))
    rest = scratch.save(rest.join(shared, "sym", "left_semi"), "rest")
    scratch.drop("classes", "shared", "several", "occurrences")
    windows = compare(rest, docs)
    found = covered.unionByName(windows).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    found = scratch.save(found, "found")
    scratch.keep("found")
    return found


def texts_of(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the documents in ``rest``, each with the list of its occurrences."""
    asked = rest.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("sym", "first", "n", "off")).alias("asked"))
    return docs.join(asked.hint("merge"), ["doc_id", "tid"]).select("doc_id", "tid", "text", "asked").dropDuplicates(["doc_id", "tid"])


def compare_in_buckets(rest: DataFrame, docs: DataFrame, contexts: Callable, solve: Callable, part: tuple[Callable, Callable], sizes: tuple, rule: str, bucket: int, scratch: Scratch) -> DataFrame:
    """Compare the windows of the occurrences of ``rest`` that have the same anchor.

    contexts: reads texts with their occurrences and gives each occurrence the bytes that its comparison needs. solve:
    finds the repeated windows in partitions sorted by key; keys with up to ``bucket`` occurrences go there. part: the
    two functions: the bytes of windows ``skip`` to ``skip`` + ``n`` of an occurrence, and what a key is made of besides
    the old key and the interval, given the occurrence's bytes, offset and number of windows, the interval's start, the
    windows to skip and the size. sizes: the intervals' sizes from coarse to 1, each a divisor of the one before.
    """
    rows = scratch.save(texts_of(rest, docs).mapInArrow(contexts, "key long, doc_id long, tid long, first int, n int, bytes binary, off int"), "contexts-0")
    scratch.drop("rest")
    done = []
    for k, size in enumerate([*sizes, None]):
        counts = rows.groupBy("key").count()
        large = scratch.save(counts.where(F.col("count") > bucket).select("key"), f"large-{k}")
        some = bool(large.limit(1).collect())
        small = rows.join(counts.where(F.col("count").between(2, bucket)).select("key"), "key", "left_semi") if k else rows.join(large, "key", "left_anti") if some else rows
        near = small.select("key", "doc_id", "tid", "first", "n", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(solve, "doc_id long, tid long, first int, n int")
        done.append(scratch.save(near, f"near-{k}"))
        if size is None or not some:
            break
        rows = scratch.save(_parts(rows.join(large, "key", "left_semi"), part, size), f"parts-{k}")
        least = F.min(F.struct("doc_id", "first", "tid")).alias("least")
        several = scratch.save(rows.groupBy("key", "ctx").agg(least, F.count("*").alias("members")).where("members > 1").drop("members"), f"several-{k}")
        members = scratch.save(rows.join(several, ["key", "ctx"]), f"members-{k}")
        later = _later(rule)
        done.append(members.where(later).select("doc_id", "tid", "first", "n"))
        first = F.struct("doc_id", "first", "tid") == F.col("least")
        rows = rows.join(several, ["key", "ctx"], "left_anti").unionByName(members.where(first | ~later).drop("least")).drop("ctx")
        rows = scratch.save(rows, f"contexts-{k + 1}")
        scratch.drop(f"contexts-{k}", f"parts-{k}", f"several-{k}")
    return reduce(DataFrame.unionByName, done)


def _parts(rows: DataFrame, part: tuple[Callable, Callable], size: int) -> DataFrame:
    """Each occurrence in parts by the intervals of ``size`` in which its windows' offsets lie, with keys of their own."""
    low = F.col("off") - F.col("n") + 1
    cut = rows.withColumn("at", F.explode(F.sequence(F.floor(low / size).cast("int"), F.floor(F.col("off") / size).cast("int")))).withColumn("at", F.col("at") * size)
    skip = F.col("off") - F.least(F.col("at") + (size - 1), F.col("off"))
    cut = cut.withColumn("skip", skip).withColumn("m", F.col("off") - F.greatest("at", low) - F.col("skip") + 1)
    own = part[1](F.col("bytes"), F.col("off"), F.col("n"), F.col("at"), F.col("skip"), size)
    cut = cut.select(F.xxhash64("key", "at", *own).alias("key"), "doc_id", "tid", (F.col("first") + F.col("skip")).alias("first"), F.col("m").alias("n"), (F.col("off") - F.col("skip")).alias("off"), part[0](F.col("bytes"), F.col("skip"), F.col("m")).alias("bytes"))
    return cut.select("key", F.xxhash64("off", "bytes").alias("ctx"), "doc_id", "tid", "first", "n", "bytes", "off")


def in_buckets(batches, solve: Callable[[list[tuple]], pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, handed to ``solve`` in lists of whole buckets with about ``at_once`` windows each.

    solve gets (bucket number, row) for each row and returns the repeated windows.
    """
    held: list[tuple] = []
    size, number, last = 0, 0, None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != last:
                if size > at_once:
                    yield solve(held)
                    held, size, number = [], 0, 0
                last, number = r[0], number + 1
            held.append((number, r))
            size += r[4]
    if held:
        yield solve(held)


def context_batches(batches, of: Callable[[bytes, list], list[bytes]]) -> Iterator[pa.RecordBatch]:
    """One row per asked occurrence with what ``of`` makes of it. A batch goes by parts of CHUNK bytes of text, since the
    occurrences and their bytes take many times the room of the texts."""
    names = ["key", "doc_id", "tid", "first", "n", "bytes", "off"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
        for x, y in chunks(lengths):
            out: list = []
            part = b.slice(x, y - x)
            for doc, tid, text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                out += [(a["sym"], doc, tid, a["first"], a["n"], z, a["off"]) for a, z in zip(asked, of(text, asked), strict=True)]
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def window_batch(doc: np.ndarray, tid: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(doc), pa.array(tid), pa.array(first.astype(np.int32)), pa.array(np.ones(len(first), np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "tid", "first", "n"])


def removed_units(n: int, spans, width: int) -> np.ndarray:
    """A mask of the units that the windows of ``spans`` cover."""
    step = np.zeros(n + 1, np.int32)
    for s in spans or ():
        step[s["first"]] += 1
        step[s["first"] + s["n"] - 1 + width] -= 1
    return np.cumsum(step[:-1]) > 0
