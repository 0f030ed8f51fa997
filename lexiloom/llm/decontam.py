"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then exact weighted similarity.

The benchmark is the query set: it is taken in blocks of bounded size, and each block is one narrow pass over all
documents, with no shuffle. Within a document, windows as long as each item are fingerprinted, with 64 bits that sum
the signs of the windows' shingle hashes. A window that holds fewer shingles known from items of its length than a
match must share can't match and needs no fingerprint. Fingerprints are cut into four Hamming blocks: those within
``radius`` of each other agree in one block up to a quarter of it, so looking up each block misses none. What is within
the radius is verified by the similarity of the two shingle multisets.

Where neither side repeats a shingle, a pair at the threshold lies beyond the radius of 24 with a chance below one in a
million (no case in 200,000 drawn pairs of each of ten lengths; 19 missed 8 in 10,000). A shingle that one side repeats
weighs as often in its fingerprint, so there is no such bound; windows or items with one are also looked up by the
shingles that they share.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, WordHashes, lower_words, mix, ngrams

RADIUS, PERCENT = 24, 80
#: Benchmark text that is sent to the executors at once.
BLOCK_BYTES = 4 << 20

_POPCOUNT = np.array([x.bit_count() for x in range(1 << 16)], np.uint8)


def _signs(grams: np.ndarray) -> np.ndarray:
    """Sums of the hashes' signs before each shingle."""
    bits = np.unpackbits(mix(grams).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    out = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as four 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Block:
    """A block of items: for each length in words, their shingles and an index of their fingerprints' blocks."""

    def __init__(self, items: list[tuple], shingle: int, radius: int, percent: int):
        self.shingle, self.radius, self.percent = shingle, radius, percent
        hashes, by_length = WordHashes(), defaultdict(list)
        for item, text in items:
            h = hashes.of(lower_words(text))
            if len(h):
                by_length[len(h)].append((item, ngrams(h, shingle)))
        self.sizes = []
        for m, own in sorted(by_length.items()):
            prints = np.concatenate([_prints(_signs(g)[-1:]) for _, g in own])
            index = []
            for j in range(4):
                values, at = np.unique(prints[:, j], return_inverse=True)
                order = np.argsort(at, kind="stable")
                index.append((values, np.split(order, np.cumsum(np.bincount(at))[:-1])))
            counts = [Counter(g.tolist()) for _, g in own]
            holders: dict[int, list[int]] = defaultdict(list)
            for i, c in enumerate(counts):
                for x in c:
                    holders[x].append(i)
            repeating = {i for i, c in enumerate(counts) if max(c.values()) > 1}
            self.sizes.append((m, [i for i, _ in own], counts, prints, index, np.unique(np.concatenate([g for _, g in own])), holders, repeating))
        grams = [np.array(s[5]) for s in self.sizes]
        self.all_grams = {k: np.unique(np.concatenate([g for g, s in zip(grams, self.sizes, strict=True) if min(s[0], shingle) == k])) for k in {min(s[0], shingle) for s in self.sizes}}

    def _near(self, prints: np.ndarray, items: np.ndarray, index: list) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius."""
        for w, p in enumerate(prints):
            found: set[int] = set()
            for j in range(4):
                values, members = index[j]
                for v in np.flatnonzero(_POPCOUNT[values ^ p[j]] <= self.radius // 4):
                    found.update(members[v].tolist())
            if found:
                own = np.array(sorted(found))
                yield from ((w, int(i)) for i in own[_POPCOUNT[items[own] ^ p].sum(axis=1) <= self.radius])

    def matches(self, words: np.ndarray, any_only: bool = False) -> list[tuple]:
        """(item, start, words, shared, all) of the best window for each matching item."""
        n, best = len(words), {}
        for k, known in self.all_grams.items():
            if n == 0 or (n < k and n < self.shingle and min(n, self.shingle) not in self.all_grams):
                continue
            grams = ngrams(words, k)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hits = np.flatnonzero(known[at] == grams)
            if not len(hits):
                continue
            signs = None
            for m, ids, counts, prints, index, own, holders, repeating in self.sizes:
                span = min(m, n) - k + 1  # shingles in a window; a document shorter than the item is one window
                if min(m, self.shingle) != k or span < 1:
                    continue
                here = own[np.minimum(np.searchsorted(own, grams[hits]), len(own) - 1)] == grams[hits]
                need = -(-self.percent * (span + m - k + 1) // (100 + self.percent))
                if here.sum() < need:
                    continue
                upto = np.zeros(len(grams) + 1, np.int32)
                upto[hits[here] + 1] = 1
                np.cumsum(upto, out=upto)
                start = np.flatnonzero(upto[span:] - upto[: len(upto) - span] >= need)
                if not len(start):
                    continue
                signs = _signs(grams) if signs is None else signs
                near = defaultdict(set)
                for w, i in self._near(_prints(signs[start + span] - signs[start]), prints, index):
                    near[w].add(i)
                for w, s in enumerate(start.tolist()):
                    seen = Counter(grams[s : s + span].tolist())
                    tried = near[w]
                    if repeating or len(seen) < span:
                        known = {i for g in seen if g in holders for i in holders[g]}
                        tried = tried | (known if len(seen) < span else known & repeating)
                    for i in sorted(tried):
                        both = sum(min(c, counts[i][g]) for g, c in seen.items() if g in counts[i])
                        union = span + counts[i].total() - both
                        if 100 * both >= self.percent * union:
                            if any_only:
                                return [(ids[i], s, min(m, n), both, union)]
                            old = best.get((m, i))
                            if old is None or both * old[4] > old[3] * union:
                                best[m, i] = (ids[i], s, min(m, n), both, union)
        return list(best.values())


def benchmark_blocks(items: DataFrame, shingle: int, radius: int, percent: int, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` bytes of text; the driver holds one at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, (r.text or "").encode()))
        size += len(held[-1][1])
        if size > limit:
            yield Block(held, shingle, radius, percent)
            held, size = [], 0
    if held:
        yield Block(held, shingle, radius, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and benchmark item (item_id, text) the
    first of the most similar windows, if its similarity is at least ``percent`` / 100.

    Words have A-Z in lower case. The similarity is that of the multisets of word shingles: shared over all. Windows
    have as many words as the item, or all of a shorter document. Items without words match nothing, and so do empty
    or missing texts. Repeated rows each give their own rows; a missing id stays null. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    out = None
    for block in benchmark_blocks(benchmark, shingle, radius, percent):

        def run(batches, block=block):
            hashes = WordHashes()
            for b in batches:
                found = [(d, i, s, m, both / union) for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for i, s, m, both, union in block.matches(hashes.of(lower_words(t)))]
                cols = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; all columns stay."""
    for block in benchmark_blocks(benchmark, shingle, radius, percent):

        @F.pandas_udf("boolean")
        def clean(text, block=block):
            import pandas as pd

            hashes = WordHashes()
            return pd.Series([not block.matches(hashes.of(lower_words((t or "").encode())), any_only=True) for t in text], dtype=bool)

        docs = docs.where(clean(F.col("text").cast("string")))
    return docs
