"""Periodic runs of words: every maximal stretch that repeats its first words at least once more.

Documents are rows, so the search is narrow: no shuffle, and a task works on a bounded stretch of documents at a time.

1. A run of at least ``least`` words has a place whose longest previous factor is at least half of that. A document in
   which no stretch of so many words comes twice has no such place, and its suffixes need no sorting.
2. In the others, words are named, and names of 1, 2, 4, ... words from each place on are refined until all suffixes
   are in order (prefix doubling, only where suffixes still agree). The same names tell how far two places agree
   forwards and backwards. Suffix order and the common prefixes of its neighbours give the longest previous factors:
   places leave the order from the last to the first, so what stands beside one are places before it.
3. Factors part the document into LZ blocks. A run either touches the start of a block or the document's end, or it lies
   strictly inside a block. The first kind has a period below the lengths of the two blocks together, or else the left
   block would have been longer (Main); extending both ways from the boundary, with one period to the right or to the
   left, finds all of them. The second kind are copies of runs strictly inside the block's earlier occurrence, which
   are kept in buckets by their start and copied block by block from left to right.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, bound_batches, mix, ngrams
from .repeats import chunks

LEAST = 12

Run = tuple[int, int, int]  # start, end, period


def suffix_names(ids: np.ndarray) -> list[np.ndarray]:
    """For each level k, names of the 2**k ids from each place on: equal for equal ids, in their order.

    The last level tells all suffixes apart and is their rank. What lies beyond the end is smaller than any id.
    """
    n = len(ids)
    _, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[at]
    names, k = [rank], 1
    todo = np.flatnonzero(count[at] > 1)
    while len(todo):
        then = todo + k
        key = rank[todo] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        old, here = rank[todo], np.arange(len(todo))
        turn, part = np.ones(len(todo), bool), np.ones(len(todo), bool)
        turn[1:], part[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
        rank = rank.copy()
        rank[todo] = old + np.maximum.accumulate(np.where(part, here, 0)) - np.maximum.accumulate(np.where(turn, here, 0))
        names.append(rank)
        size = np.diff(np.append(np.flatnonzero(part), len(todo)))
        todo, k = todo[np.repeat(size > 1, size)], 2 * k
    return names


def agree_forwards(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many ids from the different places i and j on are equal."""
    n, out = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = i + out, j + out
        same = (a < n) & (b < n)
        same[same] = names[k][a[same]] == names[k][b[same]]
        out += same.astype(np.int64) << k
    return out


def agree_backwards(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many ids before the different places i and j are equal."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        a, b = i - out - (1 << k), j - out - (1 << k)
        same = (a >= 0) & (b >= 0)
        same[same] = names[k][a[same]] == names[k][b[same]]
        out += same.astype(np.int64) << k
    return out


def previous_factors(names: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest stretch from it on that also starts earlier, and where it does."""
    rank = names[-1]
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = [0, *agree_forwards(names, order[:-1], order[1:]).tolist(), 0]
    at, sa = rank.tolist(), order.tolist()
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    factor, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = at[i]
        x, y, p, q = common[r], common[after[r]], before[r], after[r]
        if x >= y:
            if x:
                factor[i], source[i] = x, sa[p]
            common[q] = y
        else:
            factor[i], source[i] = y, sa[q]
            common[q] = x
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
    return factor, source


def _blocks(factor: list[int], source: list[int], start: int, end: int) -> list[tuple[int, int, int]]:
    """LZ blocks of a document as (start, length, earlier start)."""
    out, at = [], start
    while at < end:
        size = factor[at] or 1
        out.append((at, size, source[at]))
        at += size
    return out


def _touching(names: list[np.ndarray], edge: np.ndarray, width: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch an edge, with periods below the edge's width."""
    size = np.maximum(width - 1, 0)
    b = np.repeat(edge, size)
    p = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size) + 1
    n, first, found = len(names[0]), names[0], []
    for i, j in ((b, b + p), (b - p, b)):  # one period to the right of the edge, or to the left
        ok = (i >= 0) & (j <= n)
        i, j, q = i[ok], j[ok], p[ok]
        near = (j < n) & (first[i] == first[np.minimum(j, n - 1)])
        near |= (i > 0) & (first[i - 1] == first[j - 1])
        i, j, q = i[near], j[near], q[near]
        f, g = agree_forwards(names, i, j), agree_backwards(names, i, j)
        run = (f + g >= q) & (f + g + q >= least)
        found.append(np.stack([(i - g)[run], (j + f)[run], q[run]], axis=1))
    return np.concatenate(found)


def find_runs(docs: list[list], least: int = LEAST) -> list[list[Run]]:
    """The runs of each document, a list of words, that have at least ``least`` words: (start, end, period), sorted."""
    ids: list[int] = []
    bounds, used = [0], 0
    for words in docs:  # each document has names of its own, so nothing agrees across documents
        own: dict = {}
        ids += [used + own.setdefault(w, len(own)) for w in words]
        used += len(own)
        bounds.append(len(ids))
    if not ids:
        return [[] for _ in docs]
    names = suffix_names(np.array(ids, np.int64))
    factor, source = previous_factors(names)
    blocks = [_blocks(factor, source, a, z) for a, z in zip(bounds, bounds[1:], strict=False)]
    edge, width = [], []
    for own in blocks:
        last = 0
        for at, size, _ in own:
            edge.append(at)
            width.append(last + size if last else 0)
            last = size
        if own:
            edge.append(at + size)
            width.append(last)
    rows = _touching(names, np.array(edge, np.int64), np.array(width, np.int64), least)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch, the smallest period
    rows = rows[new]
    cut = np.searchsorted(rows[:, 0], bounds)
    out = []
    for d, own in enumerate(blocks):
        buckets: dict[int, list[tuple[int, int]]] = {}
        for s, e, p in rows[cut[d] : cut[d + 1]].tolist():
            buckets.setdefault(s, []).append((e, p))
        starts = sorted(buckets)
        for at, size, earlier in own:
            if size < least + 2 or earlier < 0 or not starts:
                continue
            k = bisect_right(starts, earlier)
            while k < len(starts) and starts[k] < earlier + size:  # grows while a block overlaps its earlier occurrence
                s = starts[k]
                copies = [(e + at - earlier, p) for e, p in buckets[s] if e < earlier + size]
                if copies:
                    to = s + at - earlier
                    if to not in buckets:
                        insort(starts, to)
                    buckets[to] = sorted({*buckets.get(to, ()), *copies})
                k += 1
        out.append(sorted((s - bounds[d], e - bounds[d], p) for s, x in buckets.items() for e, p in x))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _suspects(docs: list[list[bytes]], hashes: WordHashes, half: int) -> list[int]:
    """Documents in which some stretch of ``half`` words comes twice (and perhaps a few others, by chance of their hashes)."""
    size = np.array([len(w) for w in docs])
    h = np.concatenate([hashes.of(w) for w in docs]) if docs else np.zeros(0, np.uint64)
    if len(h) < half:
        return []
    grams = ngrams(h, half)
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64), size)
    whole = owner[: len(grams)] == owner[half - 1 :]
    key = np.sort((mix(grams[whole]) & ~np.uint64(0xFFFF)) | owner[: len(grams)][whole])
    return np.unique(key[1:][key[1:] == key[:-1]] & np.uint64(0xFFFF)).astype(int).tolist()


def _search(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, texts = b.column(0), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for all_x, all_y in chunks([len(t) for t in texts]):
                for x in range(all_x, all_y, 1 << 16):
                    y = min(all_y, x + (1 << 16))
                    docs = [t.split() for t in texts[x:y]]
                    some = _suspects(docs, hashes, (least + 1) // 2)
                    found = dict(zip(some, find_runs([docs[i] for i in some], least), strict=True))
                    runs, kept = [], []
                    for i, words in enumerate(docs):
                        own = found.get(i, ())
                        if own:
                            step = np.zeros(len(words) + 1, np.int32)
                            for s, e, p in own:
                                step[s + p] += 1
                                step[e] -= 1
                            gone = np.cumsum(step[:-1]) > 0
                            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                        runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in own])
                        kept.append(b" ".join(words))
                    cols = [ids.slice(x, y - x), pa.array([len(d) for d in docs], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "kept_text"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs and kept_text.

    runs: an array of (start, length, period), sorted by start and period, of the maximal stretches of words with that
    smallest period that have at least ``least`` words and two periods. Words are runs of anything but ASCII blanks.
    kept_text: the words, joined by blanks, without those that a run contains after its first period. Empty and missing
    texts have no words and no runs. Each row stands for itself: repeated rows and missing ids make no difference.
    Other columns are not read.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def with_looped_ends(docs: DataFrame) -> DataFrame:
    """``docs`` with some texts changed to end in a loop: those whose id's CRC-32 is divisible by ten.

    With g the tenth of it, a text of n words keeps its first a = g mod n and repeats the next p = 1 + floor((n - a) /
    (3 + g mod 8)) in place of the rest. Texts without words or id stay as they are.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumns({"_loop_g": F.floor(crc / 10), "_loop_words": F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))})
    n = F.size("_loop_words").cast("long")
    rows = rows.withColumn("_loop_a", F.when(n > 0, F.col("_loop_g") % n))
    a = F.col("_loop_a")
    rows = rows.withColumn("_loop_p", F.when(n > 0, F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_loop_g") % 8))))
    loop = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get("_loop_words", (a + i % F.col("_loop_p")).cast("int")))
    text = F.when(n > 0, F.array_join(F.concat(F.slice("_loop_words", 1, a.cast("int")), loop), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_loop_g", "_loop_words", "_loop_a", "_loop_p")
