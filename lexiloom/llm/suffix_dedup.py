"""Substring dedup over bytes with longest-previous-factor arrays.

Suffixes are compared up to ``width`` bytes. Sorting all of a corpus's suffixes in one order is not needed for that:
suffixes that agree on ``width`` bytes share an anchor, the byte gram of least hash in them (see ``repeats``), so the
suffix order is built bucket by bucket. In a bucket, a suffix's longest previous factor is the longer of its common
prefixes with the nearest entries, before and after it in suffix order, that stand at smaller text positions; the
longest next factor is the same with larger positions. A suffix whose previous factor reaches ``width`` repeats an
earlier one: removing those keeps the first copy. Where any other copy counts, the next factor counts too.

A bucket with many different members (a frequent passage's edge) is not given to one task: it is split by further
bytes on either side of the gram until its parts are small or all the same window (see ``repeats``), and the order of
suffixes is built in the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix
from .repeats import Rolling, chunks, compare_in_buckets, context_batches, find_repeats, in_buckets, occurrence_batch, removed_units, window_batch

WIDTH, GRAM, BUCKET = 200, 32, 64
#: Intervals of the gram's offset by which large buckets are split.
SIZES = (64, 16, 4, 1)
#: Suffixes that are sorted at once within a task.
AT_ONCE = 1 << 14


def _bytes(text: bytes) -> np.ndarray:
    return mix(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1))


def _window_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost least value in each stretch of ``span``."""
    best, size = np.arange(len(values), dtype=np.int32), 1
    while size * 2 <= span:
        x, y = best[:-size], best[size:]
        best, size = np.where(values[y] < values[x], y, x), size * 2
    m = len(values) - span + 1
    x, y = best[:m], best[span - size : span - size + m]
    return np.where(values[y] < values[x], y, x)


def _occurrences(width: int, gram: int):
    def run(batches):
        for b in batches:
            ids, tids = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for x, y in chunks([len(t) for t in texts]):
                size = np.array([len(t) for t in texts[x:y]])
                total = int(size.sum())
                if total < width:
                    continue
                roll = Rolling(_bytes(b"".join(texts[x:y])))
                at = np.arange(total - gram + 1)
                grams = roll.of(at, at + gram)
                pick = _window_minimum(grams, width - gram + 1)
                offset = np.cumsum(size) - size
                owner = np.repeat(np.arange(y - x), size)
                start = np.arange(total - width + 1)
                whole = owner[: len(start)] == owner[width - 1 :]
                turn = np.empty(len(start), bool)
                turn[:1], turn[1:] = True, (pick[1:] != pick[:-1]) | ~whole[:-1]
                turn &= whole
                first = np.flatnonzero(turn)
                if not len(first):
                    continue
                group = np.cumsum(turn)[whole] - 1
                n = np.bincount(group, minlength=len(first))
                d = owner[first]
                yield occurrence_batch(grams[pick[first]], roll.of(first, first + n - 1 + width), pick[first] - first, ids[x:y][d], tids[x:y][d], first - offset[d], n)

    return run


def _contexts(width: int):
    return lambda batches: context_batches(batches, lambda text, asked: [text[a["first"] : a["first"] + a["n"] - 1 + width] for a in asked])


def previous_factors(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors of the entries of a suffix order.

    position: of each entry, all different; lcp[i]: common prefix of entries i - 1 and i. Both neighbours at smaller
    positions are found by jumping over entries at larger ones; a jump's common prefix is the least on its way.
    """
    n = len(position)
    best = np.zeros(n, lcp.dtype)
    for way in (1, -1):
        pos, own = position[::way], (lcp if way == 1 else np.append(lcp[1:], 0)[::-1])
        near, common = np.arange(n) - 1, own.copy()  # everything between near[i] and i stands at a larger position than i
        todo = np.flatnonzero((near >= 0) & (pos[near] > pos))
        while len(todo):
            j = near[todo]
            common[todo] = np.minimum(common[todo], common[j])
            near[todo] = near[j]
            todo = todo[(near[todo] >= 0) & (pos[near[todo]] > pos[todo])]
        common[near < 0] = 0
        best = np.maximum(best, common[::way])
    return best


def _suffix_order(buckets: list[tuple], width: int):
    """Of the windows of some whole buckets: owner row, offset, text position, and the order's common prefixes."""
    grid, row, shift = [], [], []
    for i, (number, (_, _, _, _, n, text)) in enumerate(buckets):
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), width)
        head = np.broadcast_to(np.frombuffer(number.to_bytes(4, "big"), np.uint8), (n, 4))
        grid.append(np.concatenate([head, windows], axis=1))
        row.append(np.full(n, i))
        shift.append(np.arange(n))
    keys, row, shift = np.concatenate(grid), np.concatenate(row), np.concatenate(shift)
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{width + 4}").ravel(), kind="stable")
    keys, row, shift = keys[order], row[order], shift[order]
    differs = keys[1:] != keys[:-1]
    lcp = np.zeros(len(row), np.int64)
    lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width + 4)
    doc = np.array([b[1][1] for b in buckets])[row]
    at = np.array([b[1][3] for b in buckets])[row] + shift
    position = np.empty(len(row), np.int64)
    position[np.lexsort((at, doc))] = np.arange(len(row))
    return row, at, position, np.maximum(0, lcp - 4)


def _factors(width: int, both: bool):
    """Windows with a previous factor (or a next one, if ``both``) of the full width; input is sorted by anchor."""

    def solve(buckets):
        row, at, position, lcp = _suffix_order(buckets, width)
        hit = previous_factors(position, lcp) >= width
        if both:
            hit |= previous_factors(-position, lcp) >= width
        row, at = row[hit], at[hit]
        doc, tid = (np.array([b[1][k] for b in buckets], np.int64)[row] for k in (1, 2))
        return window_batch(doc, tid, at)

    return lambda batches: in_buckets(batches, solve, AT_ONCE)


def _part(width: int):
    """Bytes of some windows; of windows whose anchors lie in an interval, the bytes that all of them share."""
    bytes_ = lambda x, skip, n: F.substring(x, skip + 1, n + (width - 1))
    return bytes_, lambda x, off, n, at, skip, size: [F.substring(x, off - at + 1, F.lit(width - size + 1))]


def _cut(width: int):
    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or b""
                mask = removed_units(len(text), spans, width)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                out.append((len(text), int(mask.sum()), len(edge) // 2, [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)], np.frombuffer(text, np.uint8)[~mask].tobytes()))
            n, gone, k, spans, kept = zip(*out, strict=True) if out else [()] * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, keep_first: bool = True, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept (binary).

    A byte of the UTF-8 text is removed if a ``width``-byte string covers it that also starts elsewhere: earlier, by
    doc_id and then position, if ``keep_first``, else anywhere. Strings lie within one document and are those of the
    input. A missing or empty text has no bytes; a missing doc_id takes no part and nothing of it is removed. Rows
    with one doc_id and equal texts count as copies of each other, and rows with one doc_id and different texts as
    different documents. A cut can fall inside a character, so what is kept is binary. Other columns are not read.
    """
    gram = min(gram, width)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "suffixes")
    rule = "earlier" if keep_first else "any"

    def compare(rest: DataFrame, docs: DataFrame) -> DataFrame:
        return compare_in_buckets(rest, docs, _contexts(width), _factors(width, not keep_first), _part(width), SIZES, rule, bucket, scratch)

    found = find_repeats(docs, _occurrences(width, gram), compare, rule, scratch)
    return docs.join(found, ["doc_id", "tid"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(width), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
