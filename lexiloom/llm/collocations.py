"""Phrase collocations by hierarchical pair naming.

A word has a name, a phrase of k words the name of the pair of phrases of k - 1 words that overlap in it: all but its
last word and all but its first. So a level is counted by pairs of adjacent names of the level before, and only where
both are frequent, since a phrase is never more frequent than its parts. The frequent names of a level are one global
table; its pairs point to their parents there, from which a phrase gets the counts of all its cuts and through which
the longer phrases say which shorter ones they hold.

Names are 64-bit hashes, so that all tasks agree on them without sending every occurrence through a join. They are
exact all the same: a pair's name and left parent determine the right one, so a name that two different pairs share
shows as two different left parents in its count, and then all starts anew with another seed. Words are told by their
text. Which names are frequent is sent to the tasks as a bitmap of fixed size; names that it can't tell apart are
counted for nothing and leave when parents are joined.

Each level is a pass over the texts that counts within stretches of bounded size, and one aggregation by name with
partial sums: no name is a hot key, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, mix

LEAST, WORDS, INSIDE, TOP = 10, 3, 50, 2000
#: log2 of the bits that tell which names are frequent.
FILTER_BITS = 26
#: Bytes of text that are counted at once.
STRETCH = 4 << 20
#: Languages whose words' names are remembered at once.
LANGUAGES = 16

_BREAK = b"\xff"  # stands in no UTF-8 text
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_U1, _U2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M1, _M2))
_SALT = np.uint64(0xA0761D6478BD642F)


def words_and_breaks(text: bytes | None) -> list[bytes]:
    """The words with A-Z in lower case, and a mark for each sign between pieces."""
    return (text or b"").lower().translate(_BREAKS).replace(_BREAK, b" \xff ").split()


class Names(WordHashes):
    """Names of a language's words; 0 stands for a break."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = 0 if word == _BREAK else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return h


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left + _SALT) + right)


def right_of(name: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The right parent of a pair, from its name and its left parent."""
    x = name * _U1
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * _U2
    return (x ^ (x >> np.uint64(32))) - mix(left + _SALT)


def has_bit(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _stretches(batches, seed: int, stretch: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words and breaks, their names) of some documents at a time."""
    known: dict[str, Names] = {}
    for b in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def named(lang: str, held=held, size=size) -> tuple[str, list[bytes], np.ndarray]:
            if lang not in known:
                if len(known) >= LANGUAGES:
                    known.clear()
                known[lang] = Names(xxhash.xxh3_64_intdigest(lang.encode(), seed))
            size.pop(lang)
            tokens = held.pop(lang)
            return lang, tokens, known[lang].of(tokens)

        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            held.setdefault(lang, []).extend(words_and_breaks(text))
            held[lang].append(_BREAK)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > stretch:
                yield named(lang)
        for lang in list(held):
            yield named(lang)


def _count_words(seed: int, stretch: int):
    def run(batches):
        for lang, tokens, names in _stretches(batches, seed, stretch):
            own, first, n = np.unique(names, return_index=True, return_counts=True)
            real = own != 0
            own, first, n = own[real], first[real], n[real]
            cols = [pa.array([lang] * len(own), pa.string()), pa.array([tokens[i] for i in first.tolist()], pa.binary()).cast(pa.string()), pa.array(own.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "name", "n"])

    return run


def _count_pairs(seed: int, filters: list, stretch: int):
    """Count the pairs of adjacent names of the last level that there is a filter for."""

    def run(batches):
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        for _, _, names in _stretches(batches, seed, stretch):
            for level, own in enumerate(bits, 1):
                frequent = (names != 0) & has_bit(own, names)
                both = frequent[:-1] & frequent[1:]
                left, right = names[:-1], names[1:]
                if level < len(bits):
                    names = np.where(both, np.maximum(pair_names(left, right), np.uint64(1)), np.uint64(0))
            left, right = left[both], right[both]
            names = pair_names(left, right)
            order = np.argsort(names, kind="stable")
            names, left = names[order], left[order]
            turn = np.ones(len(names), bool)
            turn[1:] = (names[1:] != names[:-1]) | (left[1:] != left[:-1])
            first = np.flatnonzero(turn)
            n = np.diff(np.append(first, len(names)))
            cols = [pa.array(names[first].view(np.int64)), pa.array(left[first].view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, ["name", "left", "n"])

    return run


def _with_right(batches):
    for b in batches:
        name, left = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(right_of(name, left).view(np.int64))], ["name", "left", "n", "right"])


def name_filter(names: DataFrame, bits: int) -> bytes:
    """A bitmap of 2**bits bits with one set for each name; tasks of 32,768 bits are joined by the driver."""
    pages = max(1, (1 << bits) // 32768)
    at = F.col("name").bitwiseAND((1 << bits) - 1)
    rows = names.select(F.floor(at / 32768).cast("long").alias("page"), (at % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(max(4096 * pages, 1))
    for r in rows.toLocalIterator():  # a bitmap of fixed size
        out[4096 * r.page : 4096 * r.page + len(r.bits)] = r.bits
    return bytes(out[: max(1, (1 << bits) // 8)])


def _levels(docs: DataFrame, words: int, least: int, seed: int, bits: int, stretch: int, scratch: Scratch) -> list[DataFrame] | None:
    """All words, and the frequent phrases of each length; None if two pairs share a name."""
    sc = docs.sparkSession.sparkContext
    counted = docs.mapInArrow(_count_words(seed, stretch), "lang string, word string, name long, n long")
    every = scratch.save(counted.groupBy("lang", "word", "name").agg(F.sum("n").alias("n")), f"words-{seed}")
    shared = every.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where(f"k > 1 and n >= {least}")
    if shared.limit(1).collect():
        return None
    none = F.array().cast("array<long>")
    level = every.where(f"n >= {least}").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("firsts"), none.alias("rests"))
    levels, filters = [every, scratch.save(level, f"frequent-1-{seed}")], []
    for k in range(2, words + 1):
        filters.append(sc.broadcast(name_filter(levels[-1].select("name"), bits)))
        counted = docs.mapInArrow(_count_pairs(seed, filters, stretch), "name long, left long, n long")
        sums = counted.groupBy("name").agg(F.min("left").alias("left"), F.max("left").alias("other"), F.sum("n").alias("n")).where(f"n >= {least}")
        sums = scratch.save(sums, f"pairs-{k}-{seed}")
        if sums.where("left != other or name = 0").limit(1).collect():
            return None
        pairs = sums.select("name", "left", "n").mapInArrow(_with_right, "name long, left long, n long, right long")
        l, r = (levels[-1].select(*[F.col(c).alias(f"{s}_{c}") for c in levels[-1].columns]) for s in ("l", "r"))
        joined = pairs.join(l, pairs["left"] == F.col("l_name")).join(r, pairs["right"] == F.col("r_name"))
        level = joined.select(
            "name", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), "n",
            F.concat("l_firsts", F.array("l_n")).alias("firsts"), F.concat("r_rests", F.array("r_n")).alias("rests"), "left", "right",
        )
        levels.append(scratch.save(level, f"frequent-{k}-{seed}"))
    return levels


def _lowest_cut(k: int):
    """(score, cut, l, r) of the lowest-scoring cut of a phrase of k words, the first of equal ones."""
    wide = lambda c: c.cast("decimal(19,0)")

    def at(i: int):
        l, r = F.get("firsts", F.lit(i - 1)), F.get("rests", F.lit(k - i - 1))
        up, down = wide(F.col("n")) * wide(F.col("n")) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)
        return F.struct(F.call_function("div", up, down).alias("score"), F.lit(i).alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*[at(i) for i in range(1, k)]))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, inside: int = INSIDE, top: int = TOP, seed: int = 0, bits: int = FILTER_BITS, stretch: int = STRETCH) -> DataFrame:
    """The ``top`` phrases of 2 to ``words`` words of each language: lang, rank, phrase, a, l, r, n, score, cut.

    docs: lang, text; a missing language is ``und``, a missing text is empty. Words have A-Z in lower case, are parted by
    blanks and tabs, and lie in one piece between the signs . , ; : ! ? and line ends. a counts a phrase, n all words of
    the language; candidates have a >= ``least``. Cutting one in two parts that occur l and r times scores
    floor(1000000 a a / (l r)); the lowest score counts, of equal ones the first cut. A candidate goes if a longer one
    that holds it occurs at least ``inside`` percent as often. Ties in score go by a and then the phrase. Each row counts,
    repeated ones too; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "phrases")
    while (levels := _levels(rows, words, least, seed, bits, stretch, scratch)) is None:
        scratch.keep()
        seed += 1
    found = None
    for k in range(2, words + 1):
        own = levels[k].withColumn("best", _lowest_cut(k))
        if k < words:
            holds = levels[k + 1].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("name"), F.col("n").alias("longer"))
            holds = holds.groupBy("name").agg(F.max("longer").alias("longer"))
            own = own.join(holds, "name", "left").where(f"longer is null or 100 * longer < {inside} * n")
        own = own.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score", "best.cut")
        found = own if found is None else found.unionByName(own)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most of the rows: its best are taken by parts first.
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(256))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = levels[0].groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
