"""Substring dedup over words by recompression.

Rounds of run naming and pair naming shorten each word sequence: a maximal run of one symbol gets a name, then every
adjacent pair whose left symbol falls in the left half of the alphabet and whose right symbol falls in the right half.
A name is a hash of what it stands for, so all tasks give equal stretches equal names with no exchange between them,
and a round is a narrow step. Next to each symbol stands the stretch of words that its making depended on: wherever
those words recur, the symbol recurs. The highest symbols inside a window are its anchors (see ``repeats``): equal
windows share them, documents that share one may share windows, and the windows themselves are then compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mix
from .repeats import Rolling, chunks, compare_in_buckets, find_repeats, in_buckets, occurrence_batch, range_argmin, removed_units, window_batch

WINDOW, ROUNDS, BUCKET = 50, 4, 64
#: Intervals of the anchor's offset by which large buckets are split.
CORE = 16
SIZES = (CORE, 1)
#: Bytes of the Arrow batches: the JVM holds several of them outside its heap for each task.
BATCH = 4 << 20
#: Windows that are compared at once within a task.
AT_ONCE = 1 << 17


def _runs(sym, lo, hi, doc, begin, end, outside):
    """Name maximal runs. Whether a symbol stands alone depends on its neighbours, or on the document's ends."""
    n = len(sym)
    same = np.zeros(n, bool)
    same[1:] = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, mix(sym[first] * np.uint64(3) + length), sym[first])
    d = doc[first]
    inner_l = first > begin[d]
    inner_r = last < end[d] - 1
    new_lo = np.where(inner_l, lo[np.maximum(first - 1, 0)], outside[0][d])
    new_hi = np.where(inner_r, hi[np.minimum(last + 1, n - 1)], outside[1][d])
    return name, new_lo, new_hi, d


def _pairs(sym, lo, hi, doc, begin, end, outside, seed):
    """Name pairs of a left and a right symbol. A right symbol alone depends on what precedes it, a left one on what follows."""
    n = len(sym)
    left = (mix(sym + np.uint64(seed)) >> np.uint64(63)) == 0
    opens = np.zeros(n, bool)
    opens[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
    second = np.zeros(n, bool)
    second[1:] = opens[:-1]
    at = np.flatnonzero(~second)
    pair, d, nxt = opens[at], doc[at], np.minimum(at + 1, n - 1)
    name = np.where(pair, mix(mix(sym[at]) * np.uint64(5) + sym[nxt] + np.uint64(seed)), sym[at])
    alone_r, alone_l = ~pair & ~left[at], ~pair & left[at]
    new_lo = np.where(alone_r, np.where(at > begin[d], lo[np.maximum(at - 1, 0)], outside[0][d]), lo[at])
    new_hi = np.where(pair, hi[nxt], np.where(alone_l, np.where(at < end[d] - 1, hi[nxt], outside[1][d]), hi[at]))
    return name, new_lo, new_hi, d


def levels(words: np.ndarray, doc: np.ndarray, n_docs: int, rounds: int):
    """(symbols, lo, hi) of each level, level 0 being the words; [lo, hi) are the words a symbol depends on."""
    sym, lo, hi = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    last = np.cumsum(np.bincount(doc, minlength=n_docs))
    outside = np.append(0, last[:-1]) - 1, last + 1  # a stretch that reaches there lies in no window
    yield sym, lo, hi
    for r in range(rounds):
        for step in (_runs, _pairs):
            size = np.bincount(doc, minlength=n_docs)
            end = np.cumsum(size)
            sym, lo, hi, doc = step(sym, lo, hi, doc, end - size, end, outside, *([r + 1] if step is _pairs else []))
        yield sym, lo, hi


def _occurrences(width: int, rounds: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ids, tids = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for x, y in chunks([len(t) for t in texts]):
                parts = [hashes.of(t.split()) for t in texts[x:y]]  # words are held for one document at a time
                size = np.array([len(p) for p in parts])
                h = np.concatenate(parts)
                offset = np.cumsum(size) - size
                start = np.concatenate([np.arange(o, o + max(0, s - width + 1)) for o, s in zip(offset, size, strict=True)] or [np.zeros(0, int)]).astype(np.int64)
                if not len(start):
                    continue
                owner = np.repeat(np.arange(y - x), np.maximum(0, size - width + 1))
                pick, level = np.full(len(start), -1), np.full(len(start), -1)
                tables = list(levels(h, np.repeat(np.arange(y - x), size), y - x, rounds))
                for k in range(rounds, -1, -1):
                    sym, lo, hi = tables[k]
                    a, z = np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + width, "right")
                    new = (level < 0) & (a < z)
                    pick[new], level[new] = range_argmin(mix(sym), a[new], z[new]), k
                turn = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (level[1:] != level[:-1]) | (owner[1:] != owner[:-1])))
                n = np.append(turn[1:], len(start)) - turn
                first = start[turn]
                sym, off = np.zeros(len(turn), np.uint64), np.zeros(len(turn), np.int64)
                for k in range(rounds + 1):
                    at = level[turn] == k
                    own = pick[turn][at]
                    sym[at], off[at] = mix(tables[k][0][own] + np.uint64(k)), tables[k][1][own] - first[at]
                ctx = Rolling(h).of(first, first + n - 1 + width)
                d = owner[turn]
                yield occurrence_batch(sym, ctx, off, ids[x:y][d], tids[x:y][d], first - offset[d], n)

    return run


def _contexts(width: int):
    """The hashes of each occurrence's windows, then those of the words that all windows of a coarse interval share.

    A part of some documents is hashed as one sequence, and all of its occurrences at once.
    """
    core = max(1, width - CORE + 1)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
            for x, y in chunks(lengths):
                part = b.slice(x, y - x)
                parts = [hashes.of((t or b"").split()) for t in part.column(2).cast(pa.binary()).to_pylist()]
                before = np.cumsum([0, *map(len, parts)])[:-1]
                roll = Rolling(np.concatenate(parts))
                asked = part.column(3).flatten()
                sym, first, n, off = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("sym", "first", "n", "off"))
                owner = np.repeat(np.arange(y - x), pc.list_value_length(part.column(3)).to_numpy(zero_copy_only=False))
                start, n, off = before[owner] + first, n.astype(np.int64), off.astype(np.int64)
                low = (off - n + 1) // CORE
                coarse = off // CORE - low + 1
                ends = np.cumsum(n + coarse)
                begin = ends - n - coarse
                of, i = _spread(n)
                found = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
                found[begin[of] + i] = roll.of(start[of] + i, start[of] + i + width)
                of, i = _spread(coarse)
                at = start[of] + off[of] - CORE * (low[of] + i)
                found[begin[of] + n[of] + i] = roll.of(at, at + core)
                sizes = np.append(0, 8 * ends).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(sizes), pa.py_buffer(found)])
                ids = [part.column(c).to_numpy()[owner] for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(sym), *map(pa.array, ids), pa.array(first), pa.array(n.astype(np.int32)), packed, pa.array(off.astype(np.int32))], ["key", "doc_id", "tid", "first", "n", "bytes", "off"])

    return run


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` items: whose it is, and its number there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _earlier(batches):
    """Windows that also start in a smaller document, among those with the same anchor."""

    def solve(buckets):
        n = np.array([r[4] for _, r in buckets])
        number, doc, tid, first = (np.repeat(np.array(x, np.int64), n) for x in ([b for b, _ in buckets], *([r[k] for _, r in buckets] for k in (1, 2, 3))))
        first += np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        hashes = np.frombuffer(b"".join(r[5][: 8 * r[4]] for _, r in buckets), np.uint64)
        order = np.lexsort((doc, hashes, number))
        turn = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (number[order][1:] != number[order][:-1]))
        least = doc[order][np.maximum.accumulate(np.where(turn, np.arange(len(order)), 0))]
        hit = order[doc[order] > least]
        return window_batch(doc[hit], tid[hit], first[hit])

    return in_buckets(batches, solve, AT_ONCE)


def _part():
    """Hashes of some windows. In a coarse interval the key is the hash of the words that its windows share, at last a window's own."""

    def own(x, off, n, at, skip, size):
        coarse = F.floor(at / CORE) - F.floor((off - n + 1) / CORE)
        return [F.substring(x, (8 * (n + coarse) + 1).cast("int"), F.lit(8)) if size == CORE else F.substring(x, 8 * skip + 1, F.lit(8))]

    return (lambda x, skip, n: F.substring(x, 8 * skip + 1, 8 * n)), own


def _cut(width: int):
    def run(batches):
        for b in batches:
            size, gone, kept = [], [], []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                mask = removed_units(len(words), spans, width)
                size.append(len(words))
                gone.append(int(mask.sum()))
                kept.append(b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated_substrings(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    A word is removed if a window of ``width`` consecutive words covers it whose word sequence also starts in a
    document with a smaller doc_id. Windows are those of the input. A missing or empty text has no words; a missing
    doc_id removes nothing and nothing of it is removed. Rows that repeat each other get the same result; rows with
    one doc_id and different texts are never compared with each other. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "recompression", BATCH)

    def compare(rest: DataFrame, docs: DataFrame) -> DataFrame:
        return compare_in_buckets(rest, docs, _contexts(width), _earlier, _part(), SIZES, "earlier_doc", bucket, scratch)

    found = find_repeats(docs, _occurrences(width, rounds), compare, "earlier_doc", scratch)
    marked = docs.join(found, ["doc_id", "tid"], "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept_text string")
