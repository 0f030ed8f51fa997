"""MinHash near-dedup with an LSH forest.

Every document has ``trees`` short signatures. Each tree is the list of all signatures in sorted order, in which
documents that share a long prefix stand together. A region is a run of documents that share ``depth`` values. In a
region with no more than ``reach`` others all pairs are candidates. In a denser one the depth grows until the run that
shares so much is that small again, and each document's nearest neighbour, which has the longest common prefix, is a
candidate at any depth. Links are confirmed on the full shingle sets.

Equal sets are first collapsed into one node, so that any number of copies costs one candidate. Confirming goes in
two rounds: first each node's best candidates; then, of the rest, those that still lie in different components,
since a link inside a component changes nothing. The links of dense regions that are not among the candidates are
found by ``dense_links``, an exact set-similarity join of those documents' shingle sets. So every pair that shares a
region in some tree is decided; a linked pair that shares none is missed, with a chance of ``MISS`` at the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, Scratch, WordHashes, lower_words, ngrams
from .components import connected_components

TREES, LEVELS, DEPTH, NEIGHBOURS = 20, 8, 5, 8
#: 64-bit words of the bitmap of a set in a dense region.
BIT_WORDS = 8
#: Shingles whose leaders a set of a dense region is held against first.
LEADERS = 8
#: The largest chance that a sparse pair exactly at the threshold shares ``depth`` values in no tree.
MISS = 3e-5


def _depth(percent: int, trees: int, levels: int) -> int:
    """The largest depth that keeps within ``MISS``; 1 if none does."""
    return max((d for d in range(1, levels + 1) if (1 - (percent / 100) ** d) ** trees <= MISS), default=1)


def _permutations(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20 + seed)
    return r.integers(0, 2**64, (n, 1), np.uint64) | np.uint64(1), r.integers(0, 2**64, (n, 1), np.uint64)


def _sketcher(shingle: int, n: int, seed: int = 0):
    def run(batches):
        mult, add = _permutations(n, seed)
        hashes = WordHashes()
        for b in batches:
            size, digest, sig = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                s = np.unique(ngrams(hashes.of(lower_words(text)), shingle))
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    sig.append(None)
                    continue
                low = None
                for k in range(0, len(s), 1024):
                    part = (((s[k : k + 1024] ^ add) * mult) >> np.uint64(32)).min(axis=1)
                    low = part if low is None else np.minimum(low, part)
                sig.append((low & np.uint64(0xFFFF)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "tid", "n_shingles", "digest", "sig"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(x == y, axis=1).sum(axis=1)


def _regions(tree: np.ndarray, keys: np.ndarray, depth: int, reach: int, lo: int, hi: int):
    """Candidates (i, j, common prefix) with lo <= i < hi among sorted rows, and whether each row's region is dense.

    Of a run only what stands in these rows is seen; ``reach`` + 1 rows on either side are enough to tell a dense one.
    """
    n, levels = len(tree), keys.shape[1]
    near = np.where(tree[1:] == tree[:-1], _common(keys[1:], keys[:-1]), 0)
    size = np.empty((levels + 1 - depth, n), np.int64)
    for d in range(depth, levels + 1):
        run = np.cumsum(np.append(0, near < d))
        size[d - depth] = np.bincount(run)[run]
    out, lcp = [], np.full(n, levels)
    for lag in range(1, min(reach, n - 1) + 1):
        lcp = np.minimum(lcp[: n - lag], near[lag - 1 :])
        i = np.arange(lo, min(hi, n - lag))
        i = i[lcp[i] >= depth]
        if not len(i):
            break
        if lag > 1:
            i = i[size[lcp[i] - depth, i] <= reach + 1]
        out.append((i, i + lag, lcp[i]))
    i, j, common = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
    return i, j, common, size[0] > reach + 1


def _neighbours(depth: int, reach: int, levels: int):
    """Candidates and dense nodes of a sorted partition, and its first and last rows for the seams."""

    def columns(b):
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, levels)
        return b.column(0).to_numpy(), keys, b.column(2).to_numpy()

    def batch(a, b, lcp, pos, tree, key, pid):
        n = len(a)
        cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lcp, pa.int32()), pa.array(np.full(n, pid), pa.int32()), pa.array(pos, pa.int64()), pa.array(tree, pa.int32()), pa.array(key, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "lcp", "pid", "pos", "tree", "key"])

    def run(batches):
        pid, at, kept, done, span = TaskContext.get().partitionId(), 0, None, 0, reach + 1
        for b in _with_end(batches):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                tree, keys, node = columns(b)
                if at < span:
                    m = min(span - at, len(node))
                    yield batch(node[:m], [None] * m, [None] * m, np.arange(at, at + m), tree[:m], [k.tobytes() for k in keys[:m]], pid)
                at += b.num_rows
                kept = (tree, keys, node) if kept is None else tuple(np.concatenate(x) for x in zip(kept, (tree, keys, node), strict=True))
            if kept is None:
                return
            tree, keys, node = kept
            upto = len(node) if b is None else max(done, len(node) - span)  # a row waits for those that its region may reach
            if upto > done:
                i, j, lcp, dense = _regions(tree, keys, depth, reach, done, upto)
                u, v, none = node[i], node[j], [None] * len(i)
                yield batch(np.minimum(u, v), np.maximum(u, v), lcp, none, none, none, pid)
                full = np.unique(node[done:upto][dense[done:upto]])
                yield batch(full, [None] * len(full), [None] * len(full), [None] * len(full), np.full(len(full), -1), [None] * len(full), pid)
            if b is not None:
                cut = max(0, upto - span)
                kept, done = tuple(x[cut:] for x in kept), upto - cut
        m = min(at, span)
        new = [len(node) - m + i for i in range(m) if at - m + i >= span]  # the others went out as first rows
        yield batch(node[new], [None] * len(new), [None] * len(new), [at - len(node) + i for i in new], tree[new], [keys[i].tobytes() for i in new], pid)
        yield batch([at], [-1], [None], [None], [None], [None], pid)  # rows of this partition

    return run


def _with_end(batches):
    yield from batches
    yield None


def _seam(depth: int, reach: int, levels: int):
    """Candidates across a partition's start, and the dense nodes around it."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("rank")
        rank, node, tree, start = (t.column(c).to_numpy() for c in ("rank", "node", "tree", "start"))
        keys = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u2").reshape(-1, levels)
        i, j, lcp, dense = _regions(tree, keys, depth, reach, 0, len(node))
        across = (rank[i] < start[i]) & (rank[j] >= start[j])
        u, v = node[i[across]], node[j[across]]
        full = np.unique(node[dense])
        a = pa.array([*np.minimum(u, v).tolist(), *full.tolist()], pa.int64())
        b = pa.array([*np.maximum(u, v).tolist(), *[None] * len(full)], pa.int64())
        return pa.table({"a": a, "b": b, "lcp": pa.array([*lcp[across].tolist(), *[None] * len(full)], pa.int32())})

    return run


def forest_candidates(nodes: DataFrame, scratch: Scratch, trees: int = TREES, levels: int = LEVELS, depth: int = DEPTH, reach: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """(a, b, score), the candidate pairs of ``nodes`` (node, sig), the score being the sum of their common prefixes;
    and (node), those in dense regions."""
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig", "node")
    rows = rows.select("tree", F.expr(f"substring(sig, tree * {2 * levels} + 1, {2 * levels})").alias("key"), "node")
    order = ["tree", "key", "node"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.save(rows.mapInArrow(_neighbours(depth, reach, levels), "a long, b long, lcp int, pid int, pos long, tree int, key binary"), "neighbours")
    pairs, full = found.where("lcp is not null").select("a", "b", "lcp"), found.where("tree = -1").select("a")
    # Seams: only the rows next to a partition's ends. The driver holds one count per partition.
    counts = {r.pid: r.a for r in found.where("b = -1").select("pid", "a").collect()}
    starts, at = {}, 0
    for pid in sorted(counts):
        starts[pid] = at
        at += counts[pid]
    near, pids, span = [], sorted(counts), reach + 1
    for i, pid in enumerate(pids):
        for step in (-1, 1):
            j = i + (step > 0)
            while 0 < j < len(pids) and starts[pid] - span <= starts[pids[j]] <= starts[pid] + counts[pid] + span:
                near.append((pid, starts[pid], starts[pids[j]]))
                j += step
            if step < 0 and i > 0 and not any(n[0] == pid and n[2] == starts[pid] for n in near):
                near.append((pid, starts[pid], starts[pid]))
    near = sorted(set(near))
    if near:
        spark = nodes.sparkSession
        seams = spark.createDataFrame(near, "pid int, first long, start long")
        ends = found.where("pos is not null").join(F.broadcast(seams), "pid").select("start", (F.col("first") + F.col("pos")).alias("rank"), F.col("a").alias("node"), "tree", "key")
        ends = ends.where(f"rank >= start - {span} and rank < start + {span}")
        across = scratch.save(ends.groupBy("start").applyInArrow(_seam(depth, reach, levels), "a long, b long, lcp int"), "seams")
        pairs = pairs.unionByName(across.where("lcp is not null"))
        full = full.unionByName(across.where("lcp is null").select("a"))
    return pairs.groupBy("a", "b").agg(F.sum("lcp").alias("score")), full.select(F.col("a").alias("node")).distinct()


def _confirm(shingle: int, percent: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                s, t = (np.unique(ngrams(hashes.of(lower_words(z)), shingle)) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    # Sort-merge at every size: a plan that broadcasts small inputs would tell nothing about large ones.
    with_a = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")
    return with_b.mapInArrow(_confirm(shingle, percent), "a long, b long")


def _gram_sets(shingle: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [np.unique(ngrams(hashes.of(lower_words(t)), shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                bits = np.zeros((len(sets), 64 * BIT_WORDS), np.uint8)
                bits[np.repeat(np.arange(len(sets)), np.diff(ends)), (flat >> np.uint64(13)) % np.uint64(64 * BIT_WORDS)] = 1
                words = pa.array(np.packbits(bits, axis=1).view(np.int64).ravel())
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BIT_WORDS), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), grams, bits], ["node", "n", "grams", "bits"])

    return run


def _similar(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for i in range(b.num_rows):
                s, t = (b.column(j)[i].values.to_numpy() for j in (2, 3))
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def dense_links(sets: DataFrame, comp: DataFrame, merged: Callable[[DataFrame, DataFrame, str], DataFrame], scratch: Scratch, percent: int) -> DataFrame:
    """The components ``comp`` (node, component), joined until no two hold similar ones of ``sets`` (node, n, grams).

    ``merged`` joins components by links (a, b), and writes them by a name.

    A shingle that only one component has can't be shared by two. Of the others each set's rarest are its prefix, as
    long as it must be for two similar sets to share one. First each set is held against the leaders of its ``LEADERS``
    rarest shingles: of the sets with a shingle, that with the fewest shingles of its own, as an original has which
    others are edited from. This joins most of a family at a cost that is linear in it. Then, for each shingle, the sets
    that are not in its largest component are held against all of other components, so that no link between
    components is left; a pair comes up once, at the first shingle that it shares. Lengths and places rule out pairs as in ``line_dedup``.
    """
    least = F.floor((F.col("n") * percent + 99) / 100)

    def placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
        of = comp.select(F.col("node").alias("_node"), F.col("component").alias("_c")).hint("merge")
        return rows.join(of, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("_c", "node")).drop("_node", "_c")

    rows = placed(sets, comp).select("node", "n", "component", F.explode("grams").alias("gram"))
    # Which shingles more than one component has, and how many sets.
    counts = rows.groupBy("gram").agg(F.count("*").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    counts = scratch.save(counts.select("gram", "k"), "dense-counts")
    mine = rows.select("n", "node", "gram").join(counts.hint("merge"), "gram")
    mine = mine.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "gram"))).alias("order"))
    mine = mine.withColumn("m", F.size("order")).withColumn("length", (F.col("m") - least + 1).cast("int")).where("length > 0")
    mine = mine.join(sets.select("node", "bits").hint("merge"), "node")
    prefixes = scratch.save(mine.select("node", "n", "m", "bits", F.posexplode(F.expr("transform(slice(order, 1, length), x -> x.gram)")).alias("place", "gram")), "dense-prefixes")

    def pairs(a: DataFrame, b: DataFrame, name: str, once: F.Column | None = None) -> DataFrame:
        n, m, i, j = F.col("a.n"), F.col("b.n"), F.col("a.place"), F.col("b.place")
        room = F.least(i, j) + 1 + F.least(F.col("a.m") - i - 1, F.col("b.m") - j - 1)
        may = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m)) & (F.col("a.component") != F.col("b.component"))
        for x, y in (("a", "b"), ("b", "a")):  # a bit that one set has and the other lacks stands for a shingle that they don't share
            lacks = reduce(lambda u, v: u + v, [F.bit_count(F.get(f"{x}.bits", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{y}.bits", F.lit(k))))) for k in range(BIT_WORDS)])
            may &= (100 + percent) * (F.col(f"{x}.n") - lacks) >= percent * (n + m)
        found = a.alias("a").join(b.alias("b").hint("merge"), "gram").where(may if once is None else may & once)
        found = found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
        return scratch.save(found.distinct() if once is None else found, name)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda end: sets.select(F.col("node").alias(end), F.col("grams").alias(f"g{end}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb")
        return scratch.save(both.mapInArrow(_similar(percent), "a long, b long"), name)

    at = scratch.save(placed(prefixes, comp), "dense-placed-1")
    leader = F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "node", "n", "m", "place", "component", "bits")).alias("e")
    first = at.groupBy("gram").agg(leader, F.count("*").alias("k")).where("k > 1").select("gram", "e.*")
    tried = pairs(at.where(F.col("place") < LEADERS), first, "dense-pairs-1")
    comp = merged(comp, verified(tried, "dense-links-1"), "dense-1")
    at = scratch.save(placed(prefixes, comp), "dense-placed-2")
    sizes = at.groupBy("gram", "component").agg(F.count("*").alias("k")).groupBy("gram").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"))
    at = at.join(sizes.where("parts > 1").hint("merge"), "gram")
    # With each shingle those before it: two sets meet at the first one that they share, and at no other.
    own = [F.first(c).alias(c) for c in ("n", "m", "bits", "component")]
    at = at.groupBy("node").agg(*own, F.array_sort(F.collect_list(F.struct("place", "gram", "main"))).alias("open"))
    at = at.select("node", "n", "m", "bits", "component", F.expr("transform(open, x -> x.gram)").alias("grams"), F.posexplode("open").alias("at", "e"))
    at = scratch.save(at.select("node", "n", "m", "bits", "component", "e.*", F.expr("slice(grams, 1, at)").alias("before")), "dense-open")
    once = ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))) & ~F.arrays_overlap("a.before", "b.before")
    more = pairs(at.where("component != main"), at, "dense-pairs-2", once).join(tried, ["a", "b"], "left_anti")
    return merged(comp, verified(more, "dense-links-2"), "dense-2")


def _agreeing(least: float):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), ">u2").reshape(b.num_rows, -1) for i in (2, 3)) if b.num_rows else (np.zeros((0, 1)), np.zeros((0, 1)))
            ok = (x == y).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, trees: int = TREES, levels: int = LEVELS, depth: int | None = None, reach: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, tid (a hash of the text).

    Two documents are linked if their shingle sets' Jaccard similarity is at least ``percent`` / 100. A missing or
    empty text has no shingles and no link. Rows with one doc_id and different texts are judged each for itself, and
    rows that repeat each other alike; a missing doc_id can't be linked: its component_id is null and it is kept.
    Other columns, whatever their names, are not read. The depth follows from the threshold unless given.
    """
    depth = _depth(percent, trees, levels) if depth is None else depth
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tid", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession, "near-dup")
    sketch = scratch.save(docs.mapInArrow(_sketcher(shingle, trees * levels), "doc_id long, tid long, n_shingles long, digest binary, sig binary"), "sketch")
    # A node for each set of shingles; it is numbered once, when the table is written.
    reps = sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "tid")).alias("of"), F.min("sig").alias("sig"))
    reps = scratch.save(reps.select("digest", "of.doc_id", "of.tid", "sig", F.monotonically_increasing_id().alias("node")), "nodes")
    cand, dense = forest_candidates(reps.select("node", "sig"), scratch, trees, levels, depth, reach)
    cand, dense = scratch.save(cand, "candidates"), scratch.save(dense, "dense")
    scratch.drop("neighbours", "seams")
    ends = cand.select(F.col("a").alias("node")).unionByName(cand.select(F.col("b").alias("node"))).distinct()
    asked = reps.select("node", "doc_id", "tid").join(ends.hint("merge"), "node", "left_semi")
    texts = scratch.save(docs.join(asked.hint("merge"), ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid", "node"]).select("node", "text"), "texts")
    # Round one: each node's best candidate among the smaller numbers, and among the larger ones.
    best = cand.groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("a")).select("a", "b")
    best = best.unionByName(cand.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b")).select("a", "b")).distinct()
    first = scratch.save(_links(best, texts, shingle, percent), "links-1")
    comp = scratch.save(connected_components(first, scratch, "cc-1"), "components-1")
    # Round two: every other candidate that would still join two components and may be similar enough.
    slack = 6 * (percent * (100 - percent) / 1e4 / (trees * levels)) ** 0.5
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")).hint("merge")
    sig = lambda end: reps.select(F.col("node").alias(end), F.col("sig").alias(f"s{end}")).hint("merge")
    open_ = cand.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    open_ = open_.join(best, ["a", "b"], "left_anti")
    open_ = open_.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing(percent / 100 - slack), "a long, b long")
    second = scratch.save(_links(scratch.save(open_, "open"), texts, shingle, percent), "links-2")

    def merged(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
        stars = comp.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return scratch.save(connected_components(stars.unionByName(links), scratch, f"cc-{name}"), f"components-{name}")

    comp = merged(comp, second, "2")
    # In dense regions, an exact join of their documents.
    if dense.limit(1).count():
        own = texts.join(dense.hint("merge"), "node", "left_semi")
        sets = scratch.save(own.mapInArrow(_gram_sets(shingle), "node long, n long, grams array<long>, bits array<long>"), "dense-sets")
        comp = dense_links(sets, comp, merged, scratch, percent)
    # A component's id is its least doc_id.
    linked = scratch.save(reps.select("node", "doc_id").join(comp.hint("merge"), "node"), "linked")
    lows = linked.groupBy("component").agg(F.min("doc_id").alias("low"))
    lows = linked.join(lows.hint("merge"), "component").select("node", "low")
    classes = reps.select("digest", "node", "doc_id").join(lows.hint("merge"), "node", "left").select("digest", F.coalesce("low", "doc_id").alias("component_id"))
    classes = scratch.save(classes, "classes")
    scratch.keep("sketch", "classes")
    out = sketch.select("doc_id", "tid", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component, "tid").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "tid")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose group holds a smaller doc_id. Of rows that share doc_id and text all or none stay."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("tid").alias("_tid")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_tid"]), "left_anti")
