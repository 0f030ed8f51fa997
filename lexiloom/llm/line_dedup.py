"""Line dedup by an exact set-similarity join.

A line is the set of its words. Equal sets are one entry, numbered in the order of their first lines, so any number of
copies costs one. In each set the words are put in order of rarity; two sets whose Jaccard similarity reaches the
threshold must share a word among the first few of each (the prefix filter), must be of similar size (the length
filter), and the places of the shared word must leave room for enough overlap (the positional filter). Each set has a
sketch of 128 bits, the parities of how many of its words fall into each of 128 bins: two sets differ in at least as many
words as their sketches do in bits, so the joins rule out pairs that differ in more than the threshold allows, and no
similar one. What passes is verified on the whole lines.

A line goes if any earlier line is similar, so one such line is enough to know. First each set is held against the
earliest set of each of its prefix words, which settles most members of a large family of variants at a cost that is
linear in it. Only sets that are still open are then joined with all. Two similar sets of several words share a second
word right behind the first one's prefix, so where a prefix word is in more than ``HOT`` sets, it is joined together
with each word behind it instead of alone.

Rarity needs only some order that is the same everywhere: words are counted in 65,536 hash buckets over all lines, and
a word's place is its bucket's rank, then its hash. Words that make up more than that share of a corpus stand apart
by their own counts, and all others are rarer.

What is grouped or joined by words or texts is dealt to ``SLICES`` slices by their hashes, one after the other, so that
the disk holds the shuffles of one slice at a time. Pairs of words get as many slices as keep them as small, or below ``LEAST`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PERCENT, BUCKETS, HOT, SLICES, LEAST = 80, 1 << 16, 512, 4, 1 << 20
_BLANKS = r"[\x20\x09-\x0D]+"
#: A set's number, size and a word's place in one long, the last two up to a limit from which on the filters let all pass.
_SIZE, _PLACE = 12, 11
#: Characters that hold a set's number.
_FIELD = 20


def _hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in its order; of a text without words, none."""
    words = F.array_remove(F.split(text, _BLANKS, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def word_ranks(docs: DataFrame) -> list[int]:
    """The rank of each bucket of words by how many words of all texts fall into it. The driver holds one number a bucket."""
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")
    words = docs.select(F.explode(F.split("text", _BLANKS, -1)).alias("word")).groupBy(bucket).agg(F.count("*").alias("n"))
    counted = {r.bucket: r.n for r in words.collect()}
    ranks = [0] * BUCKETS
    for k, b in enumerate(sorted(range(BUCKETS), key=lambda b: (counted.get(b, 0), b))):
        ranks[b] = k
    return ranks


def line_sets(docs: DataFrame, ranks: list[int], percent: int) -> DataFrame:
    """(doc_id, tid, line_no, set_id, check, n, low, high, codes): the lines that have words, with one code more than their prefixes.

    A code is a word's rank and 47 bits of its hash; the order of codes is that of rarity.
    """
    known = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")
    lines = docs.where("doc_id is not null").select("doc_id", "tid", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]")))
    code = lambda h: F.shiftleft(F.get(known, F.pmod(h, F.lit(BUCKETS)).cast("int")), 47).bitwiseOR(F.shiftrightunsigned(h, 17))
    lines = lines.select("doc_id", "tid", "line_no", F.sort_array(F.array_distinct(F.transform(_hashes(F.col("line")), code))).alias("all"))
    n = F.size("all")
    length = n - F.floor((n * percent + 99) / 100).cast("int") + 2
    sketch = [_parities("all", half).alias(name) for half, name in ((0, "low"), (1, "high"))]
    return lines.select("doc_id", "tid", "line_no", F.xxhash64("all").alias("set_id"), F.hash("all").alias("check"), n.alias("n"), *sketch, F.slice("all", F.lit(1), length).alias("codes"))


def _parities(codes: str, half: int) -> Column:
    """One half of a sketch: a bit for each of 64 bins, whether an odd number of the words falls into it."""
    mine = lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - half))
    bit = lambda c: F.call_function("shiftleft", mine(c).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def different_sets(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(set_id, check, first, n, low, high, codes): one row per set, with its first line."""
    first = F.min(F.struct("doc_id", "line_no", "tid")).alias("first")
    for k in range(SLICES):
        own = lines.where(F.pmod("set_id", F.lit(SLICES)) == k)
        sets = scratch.add(own.groupBy("set_id", "check").agg(first, *[F.first(c).alias(c) for c in ("n", "low", "high", "codes")]), "sets-any")
        scratch.tidy()
    return sets


def numbered(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, set_id, check, n, low, high, codes, doc_id, tid, line_no): the sets, numbered in the order of their first lines."""
    sets = sets.repartitionByRange("first").sortWithinPartitions("first")
    sets = scratch.save(sets.select("set_id", "check", "n", "low", "high", "codes", "first.*", F.monotonically_increasing_id().alias("at")), "sets-raw")
    part = F.shiftright("at", 33).cast("int")
    scratch.drop("sets-any")
    counts = sorted((r.part, r.n) for r in sets.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one number a partition
    starts, total = [0] * ((counts[-1][0] if counts else 0) + 1), 0
    for p, n in counts:
        starts[p], total = total, total + n
    if total >= 1 << (63 - _SIZE - _PLACE):
        raise ValueError("too many different lines to number")
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), part)
    return sets.select((start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "set_id", "check", "n", "low", "high", "codes", "doc_id", "tid", "line_no")


def _packed(place) -> Column:
    low = lambda c, bits: F.least(c.cast("long"), F.lit((1 << bits) - 1))
    return F.shiftleft(F.shiftleft(F.col("id"), _SIZE).bitwiseOR(low(F.col("n"), _SIZE)), _PLACE).bitwiseOR(low(place, _PLACE))


def _id(packed) -> Column:
    return F.shiftright(packed, _SIZE + _PLACE)


def _may_match(a, b, percent: int) -> Column:
    """The length and positional filters for two packed rows that share a prefix word."""
    of = lambda x, bits, at: F.shiftright(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    n, m, i, j = of(a, _SIZE, _PLACE), of(b, _SIZE, _PLACE), of(a, _PLACE, 0), of(b, _PLACE, 0)
    room = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    unknown = (F.greatest(n, m) == (1 << _SIZE) - 1) | (F.greatest(i, j) == (1 << _PLACE) - 1)
    return unknown | ((100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m)))


def _may_differ(bits: Column, n, m, percent: int) -> Column:
    """Whether sets of n and m words that differ in ``bits`` words at least may reach the threshold."""
    return (100 + percent) * (n + m - bits) >= 2 * percent * (n + m)


def _near(x, y, low: str, high: str, l: str, h: str, percent: int) -> Column:  # noqa: E741
    """Whether two packed rows may match by their sizes, places and sketches."""
    bits = F.bit_count(F.col(low).bitwiseXOR(F.col(l))) + F.bit_count(F.col(high).bitwiseXOR(F.col(h)))
    size = lambda c: F.shiftright(c, _PLACE).bitwiseAND(F.lit((1 << _SIZE) - 1))
    alike = _may_differ(bits, size(x), size(y), percent) | (F.greatest(size(x), size(y)) == (1 << _SIZE) - 1)
    return alike & _may_match(F.col(x), F.col(y), percent)


def _pairs(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """(id, earlier): the pairs of rows (code, x, low, high) of ``a`` with earlier ones of ``b`` that may match, once each."""
    a, b = a.alias("a"), b.alias("b")
    rows = a.join(b.hint("merge"), [F.col("a.code") == F.col("b.code"), F.col("b.x") < F.col("a.x"), _near("a.x", "b.x", "a.low", "a.high", "b.low", "b.high", percent)])
    return rows.select(_id("a.x").alias("id"), _id("b.x").alias("earlier")).where("earlier < id").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(id): of the pairs (id, earlier) those whose lines are similar, told by the whole lines."""
    asked = pairs.select("id").unionByName(pairs.select(F.col("earlier").alias("id"))).distinct()
    asked = sets.select("id", "doc_id", "tid", "line_no").join(asked.hint("merge"), "id", "left_semi")
    # A document's asked numbers as one row of fields, one for each of its lines, so that each is looked up at once.
    asked = asked.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("line_no", "id"))).alias("a"))
    behind = lambda x, i: x["line_no"] - F.coalesce(F.when(i > 0, F.get("a", i - 1)["line_no"]), F.lit(-1))
    fields = F.array_join(F.transform("a", lambda x, i: F.lpad(x["id"].cast("string"), behind(x, i) * _FIELD, " ")), "").cast("binary")
    asked = scratch.save(asked.select("doc_id", "tid", fields.alias("fields")), f"asked-{name}")
    scratch.tidy()
    number = lambda i: F.trim(F.substring("fields", i * _FIELD + 1, F.lit(_FIELD)).cast("string")).try_cast("long")
    found = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(number(i).alias("id"), i.alias("line_no"), x.alias("line"))), lambda y: y["id"].isNotNull())
    for k in range(SLICES):
        own = F.pmod(F.xxhash64("doc_id", "tid"), F.lit(SLICES)) == k
        texts = docs.where(own).join(asked.where(own).hint("shuffle_hash"), ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"])
        rows = texts.select("doc_id", F.explode(found).alias("a")).select(F.col("a.id").alias("id"), F.struct("doc_id", "a.line_no").alias("place"), F.col("a.line").alias("line"))
        lines = scratch.add(rows.select("id", "place", F.array_distinct(_hashes(F.col("line"))).alias("words")), f"words-{name}")
        scratch.tidy()
    theirs = lines.select(F.col("id").alias("earlier"), F.col("place").alias("before"), F.col("words").alias("others"))
    rows = pairs.join(lines.hint("merge"), "id").join(theirs.hint("merge"), "earlier").where("before < place")  # one place in two texts of one id is neither
    both = F.size(F.array_intersect("words", "others"))
    found = scratch.save(rows.where(100 * both >= percent * (F.size("words") + F.size("others") - both)).select("id").distinct(), f"similar-{name}")
    scratch.drop(f"words-{name}", f"asked-{name}")
    return found


def _prefix_rows(sets: DataFrame, k: int) -> DataFrame:
    """(code, x, low, high): one slice of the sets' prefix words."""
    prefix = F.posexplode(F.slice("codes", F.lit(1), F.size("codes") - 1)).alias("place", "code")
    rows = sets.select("id", "n", "low", "high", prefix).where(F.pmod("code", F.lit(SLICES)) == k)
    return rows.select("code", _packed(F.col("place")).alias("x"), "low", "high")


def _hot_rows(sets: DataFrame, k: int, slices: int) -> DataFrame:
    """(code, x, low, high, open): one slice of the hot prefix words with each word behind them."""
    rows = sets.select("id", "n", "low", "high", "codes", "hots", "open", F.posexplode("codes").alias("place", "code"))
    rows = rows.where(F.col("place") < F.size("codes") - 1).where(F.array_contains("hots", F.col("code")))
    rows = rows.select("code", "open", _packed(F.col("place")).alias("x"), "low", "high", F.explode(F.expr("slice(codes, place + 2, size(codes))")).alias("second"))
    rows = rows.select(F.xxhash64("code", "second").alias("code"), "x", "low", "high", "open")
    return rows.where(F.pmod("code", F.lit(slices)) == k)


def similar_sets(sets: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(id): the sets that are similar to an earlier one."""
    for k in range(SLICES):
        rows = _prefix_rows(sets, k)
        # A word of one set only can't bring two together.
        known = rows.groupBy("code").agg(F.min("x").alias("y"), F.min_by("low", "x").alias("l"), F.min_by("high", "x").alias("h"), F.count("*").alias("k")).where("k > 1")
        known = scratch.save(known, "earliest")
        scratch.tidy()
        rows = rows.join(known.hint("shuffle_hash"), "code")
        earlier = F.when((F.col("y") < F.col("x")) & (_id("y") < _id("x")) & _near("x", "y", "low", "high", "l", "h", percent), _id("y")).alias("earlier")
        rows = scratch.save(rows.select("code", "x", "low", "high", earlier, (F.col("k") > HOT).alias("hot")), "rows")
        scratch.drop("earliest")
        tried = scratch.add(rows.where("earlier is not null").select(_id("x").alias("id"), "earlier"), "tried")
        hot = scratch.add(rows.where("hot").select(_id("x").alias("id"), "code"), "hot-words")
        one = rows.where("not hot").select("code", "x", "low", "high")
        more = scratch.add(_pairs(one, one, percent), "more")
        scratch.drop("rows")
    tried = scratch.save(tried.distinct(), "pairs-1")
    scratch.drop("tried")
    settled = _similar(tried, sets, docs, percent, scratch, "1")
    scratch.tidy()
    # Open sets against all that share a prefix word with them; pairs that were tried need no second look.
    two = sets.select("id", "n", "low", "high", "codes").join(hot.groupBy("id").agg(F.collect_list("code").alias("hots")).hint("merge"), "id")
    two = two.join(settled.select("id", F.lit(True).alias("settled")).hint("merge"), "id", "left")
    two = scratch.save(two.select("id", "n", "low", "high", "codes", "hots", F.col("settled").isNull().alias("open")), "hot")
    scratch.drop("hot-words")
    behind = F.aggregate(F.sequence(F.lit(1), F.size("codes") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(F.array_contains("hots", F.get("codes", i - 1)), F.size("codes") - i).otherwise(0))
    most = max((sets.agg(F.sum(F.size("codes") - 1)).first()[0] or 0) // SLICES, LEAST)  # rows of a slice
    slices = -(-(two.agg(F.sum(behind)).first()[0] or 0) // most)
    for k in range(slices):
        rows = _hot_rows(two, k, slices)
        more = scratch.add(_pairs(rows.where("open").drop("open"), rows.drop("open"), percent), "more")
        scratch.tidy()
    more = more.distinct().join(settled.hint("merge"), "id", "left_anti").join(tried.hint("merge"), ["id", "earlier"], "left_anti")
    more = scratch.save(more, "pairs-2")
    scratch.drop("more", "hot")
    return settled.unionByName(_similar(more, sets, docs, percent, scratch, "2"))


def remove_similar_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, kept_text.

    Lines are parted by line feeds. A line goes if a line before it, by doc_id and then by place, has a word set of
    Jaccard similarity ``percent`` / 100 (above a half) or more; what else goes doesn't matter. Lines without words
    stay. An empty text is one empty line, a missing one has none. A missing doc_id takes no part and keeps all lines.
    Repeated rows are one document; rows with one doc_id and different texts are compared by doc_id and place like all
    others. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(line_sets(docs, word_ranks(docs), percent), "lines")
    sets = different_sets(lines, scratch)
    lines = scratch.save(lines.select("doc_id", "tid", "line_no", "set_id", "check"), "places")
    scratch.drop("lines")
    sets = numbered(sets, scratch)
    gone = similar_sets(sets, docs, scratch, percent).select("id", F.lit(True).alias("similar"))
    known = sets.join(gone.hint("merge"), "id", "left").select("set_id", "check", "similar", F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    out = lines.select("doc_id", "tid", "line_no", "set_id", "check").join(scratch.save(known, "known").hint("merge"), ["set_id", "check"])
    out = out.where(F.coalesce("similar", F.lit(False)) | (F.struct("doc_id", "line_no") > F.struct(F.col("d").alias("doc_id"), F.col("l").alias("line_no"))))
    gone = out.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("line_no")).alias("g"))
    # One sign for each line, so that each is looked up at once.
    behind = lambda x, i: x - F.coalesce(F.when(i > 0, F.get("g", i - 1)), F.lit(-1))
    signs = F.array_join(F.transform("g", lambda x, i: F.lpad(F.lit("1"), behind(x, i), "0")), "").cast("binary")
    gone = scratch.save(gone.select("doc_id", "tid", F.size("g").cast("long").alias("n_gone"), signs.alias("signs")), "removed")
    scratch.keep("removed")
    rows = docs.join(gone.hint("shuffle_hash"), ["doc_id", "tid"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.filter("lines", lambda x, i: F.coalesce(F.substring("signs", i + 1, F.lit(1)) != F.lit(bytearray(b"1")), F.lit(True)))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("kept_text"))
