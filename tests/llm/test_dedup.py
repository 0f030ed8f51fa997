"""The duplicate removers against brute force, over rows of all odd kinds."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.llm import line_dedup, near_dup, recompression, suffix_dedup
from lexiloom.llm.common import Scratch
from lexiloom.llm.repeats import context_batches, range_argmin

from .conftest import sentence


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows, percent):
    """The least doc_id reachable from each row."""
    own = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    at = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        for g in own[i] if d is not None else ():
            at[g].append(i)
    for i, (d, _) in enumerate(rows):
        shared = defaultdict(int)
        for g in own[i] if d is not None else ():
            for j in at[g]:
                if j < i:
                    shared[j] += 1
        for j, both in shared.items():
            if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [None if d is None else low[root(i)] for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd, percent):
    r = random.Random(2)
    x, y = sentence(r, 90), sentence(r, 90)
    more = spark.createDataFrame([(33, x + " end"), (45, x), (45, y), (50, y + " end"), (50, y + " end")], "doc_id long, text string")  # one id with two texts
    odd = odd.unionByName(more, allowMissingColumns=True)
    rows = rows_of(odd)
    want = components(rows, percent)
    got = near_dup.near_duplicates(odd, percent).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((d, len(shingles(t)), c) for (d, t), c in zip(rows, want, strict=True)), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = near_dup.drop_near_duplicates(odd, percent)
    assert kept.columns == odd.columns and sorted(rows_of(kept), key=key) == sorted((x for x, c in zip(rows, want, strict=True) if x[0] == c), key=key)


def test_recall_of_sparse_pairs(spark):
    """Pairs that stand alone, right at the threshold and above it: all are found."""
    r = random.Random(12)
    rows = []
    for i in range(600):
        base = sentence(r, r.randint(60, 200)).split()
        rows.append((2 * i, " ".join(base)))
        w = list(base)
        for _ in range(r.randint(1, max(1, len(base) // 60))):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((2 * i + 1, " ".join(w)))
    want = components(rows, 85)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert sum(w != d for (d, _), w in zip(rows, want, strict=True)) > 300
    assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}


def test_near_duplicates_in_a_family_with_few_links(spark):
    """Copies with three words changed each: median similarity 0.82, links at 0.90 are rare."""
    r = random.Random(11)
    base = sentence(r, 300).split()
    rows = []
    for i in range(1504):
        w = list(base)
        for k in r.sample(range(300), 3):
            w[k] = sentence(r, 1)
        rows.append((i, " ".join(w)))
    want = components(rows, 90)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()}
    assert sum(w != d for (d, _), w in zip(rows, want, strict=True)) > 3
    assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}


def test_near_duplicates_in_a_large_family(spark):
    r = random.Random(1)
    base = sentence(r, 150).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = sentence(r, 1)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, sentence(r, 80)) for i in range(50)]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {d: w for (d, _), w in zip(rows, components(rows, 85), strict=True)}


def test_near_duplicates_of_one_original(spark):
    """Copies with edits of their own: each one's only link is to the original (0.87; among copies 0.76)."""
    r = random.Random(4)
    base = sentence(r, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 1501):
        w = list(base)
        at = r.randrange(5, 130)
        for k in (at, r.choice([x for x in range(5, 145) if abs(x - at) > 5])):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert len(got) == 1501 and {x.component_id for x in got} == {0}


def test_regions(spark):
    """Small runs give all their pairs; in a dense one the depth grows until runs are small; nearest neighbours always."""
    r = np.random.default_rng(0)
    keys = np.sort(np.array([[0, 0, a, b] for a, b in r.integers(0, 6, (40, 2))] + [[1, i, i, i] for i in range(5)] + [[2, 2, 2, i] for i in range(4)], np.uint16).view("V8").ravel())
    keys = np.array(sorted(k.tobytes() for k in keys.view(np.uint16).reshape(-1, 4).astype(">u2")))
    rows = [np.frombuffer(k.ljust(8, b"\0"), ">u2") for k in keys.tolist()]
    common = lambda a, b: next((k for k in range(4) if a[k] != b[k]), 4)
    runs = lambda i, d: sum(common(rows[i], x) >= d for x in rows)
    want = {(i, j) for j in range(len(rows)) for i in range(j) if (c := common(rows[i], rows[j])) >= 2 and (j == i + 1 or runs(i, c) <= 9)}
    nodes = [(i, bytearray(x.tobytes())) for i, x in enumerate(rows)]
    pairs, dense = near_dup.forest_candidates(spark.createDataFrame(nodes, "node long, sig binary").coalesce(1), Scratch(spark, "test"), trees=1, levels=4, depth=2)
    got = {(x.a, x.b) for x in pairs.collect()}
    assert {x.node for x in dense.collect()} == {i for i in range(len(rows)) if runs(i, 2) > 9}
    assert got >= want and len(got) <= 2 * len(want)


def test_dense_runs_across_partitions(spark):
    """Runs longer than the reach are told also where no partition holds one."""
    nodes = spark.createDataFrame([(i, bytearray(range(16))) for i in range(20)], "node long, sig binary")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs, dense = near_dup.forest_candidates(nodes, Scratch(spark, "test"), trees=1)
        assert {(x.a, x.b) for x in pairs.collect()} >= {(i, i + 1) for i in range(19)}
        assert {x.node for x in dense.collect()} == set(range(20))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("percent", [80, 85])
def test_depth_follows_from_the_threshold(monkeypatch, percent):
    used = []

    def stop(nodes, scratch, trees, levels, depth, reach):
        used.append((1 - (percent / 100) ** depth) ** trees)
        raise StopIteration

    class Any:
        def __getattr__(self, name):
            return lambda *args, **kwargs: self

    monkeypatch.setattr(near_dup, "forest_candidates", stop)
    monkeypatch.setattr(near_dup, "Scratch", lambda *args: Any())
    monkeypatch.setattr(near_dup, "F", Any())
    with pytest.raises(StopIteration):
        near_dup.near_duplicates(Any(), percent)
    assert used[0] <= 3e-5


def cut_bytes(rows, width, keep_first):
    seen = defaultdict(list)
    data = [(d, i, (t or "").encode()) for i, (d, t) in enumerate(rows)]
    for d, i, b in data:
        if d is not None:
            for k in range(len(b) - width + 1):
                seen[b[k : k + width]].append((d, k, i))
    out = {}
    for d, i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1) if d is not None else ():
            at = seen[b[k : k + width]]
            if len(at) > 1 and (not keep_first or min(at)[:2] < (d, k)):
                gone[k : k + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)))
        out[i] = (len(b), int(gone.sum()), len(edges) // 2, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("bucket", [1, 64])
def test_suffix_dedup(spark, odd, keep_first, bucket):
    rows = rows_of(odd)
    want = sorted((d, w) for (d, _), w in zip(rows, cut_bytes(rows, 200, keep_first).values(), strict=True) if d is not None)
    got = suffix_dedup.remove_repeated_bytes(odd, 200, keep_first, bucket=bucket).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got if r.doc_id is not None) == want
    assert all(r.n_removed == 0 for r in got if r.doc_id is None) and len(got) == len(rows)


@pytest.mark.parametrize("keep_first", [True, False])
def test_suffix_dedup_of_large_buckets(spark, keep_first):
    """A passage and parts of it in many documents with text of their own around it."""
    r = random.Random(5)
    passage = sentence(r, 60)
    rows = [(i, sentence(r, r.randint(0, 12)) + passage[r.randint(0, 40) : len(passage) - r.randint(0, 40)] + sentence(r, r.randint(0, 12))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((d, w) for (d, _), w in zip(rows, cut_bytes(rows, 200, keep_first).values(), strict=True))
    for bucket in (1, 8):
        got = suffix_dedup.remove_repeated_bytes(df, 200, keep_first, bucket=bucket).collect()
        assert sorted((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept))) for x in got) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_previous_factors(text):
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(n - max(a, b)) if text[a + k] != text[b + k]), n - max(a, b))
    lcp = np.array([0] + [common(order[i - 1], order[i]) for i in range(1, n)])
    got = suffix_dedup.previous_factors(np.array(order), lcp)
    assert {p: int(x) for p, x in zip(order, got, strict=True)} == {i: max((common(j, i) for j in range(i)), default=0) for i in range(n)}


def cut_words(rows, width):
    first = {}
    for d, t in rows:
        if d is not None:
            w = (t or "").encode().split()
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[k : k + width])] < d:
                gone[k : k + width] = True
        out.append((d is not None, d or 0, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_recompression(odd):
    rows = rows_of(odd)
    got = recompression.remove_repeated_substrings(odd, 50).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got) == cut_words(rows, 50)


def test_recompression_of_runs_and_shared_passages(spark):
    r = random.Random(3)
    passage = sentence(r, 70)
    rows = [(i, " ".join([sentence(r, r.randint(0, 30)), passage if i % 3 else "a " * r.randint(0, 90), sentence(r, 20), "b c " * r.randint(0, 60)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, rounds, bucket in ((50, 3, 1), (50, 5, 64), (8, 3, 2)):
        got = recompression.remove_repeated_substrings(df, width, rounds, bucket).collect()
        assert sorted((True, x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == cut_words(rows, width)


def test_range_argmin():
    r = np.random.default_rng(0)
    v = r.integers(0, 9, 60).astype(np.uint64)
    lo = r.integers(0, 59, 200)
    hi = np.minimum(60, lo + r.integers(1, 30, 200))
    assert [int(x) for x in range_argmin(v, lo, hi)] == [int(a + v[a:b].argmin()) for a, b in zip(lo, hi, strict=True)]


def cut_lines(rows, percent):
    lines = sorted({(d, i, frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", ln) if x)) for d, t in rows if d is not None and t is not None for i, ln in enumerate(t.split("\n"))}, key=lambda x: x[:2])
    gone = set()
    for k, (d, i, s) in enumerate(lines):
        if s and any((e, j) < (d, i) and 100 * len(s & o) >= percent * len(s | o) for e, j, o in lines[:k] if o):
            gone.add((d, i, s))
    return gone


def test_line_dedup(odd):
    rows = rows_of(odd)
    gone = cut_lines(rows, 80)
    words = lambda ln: frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", ln) if x)
    want = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [ln for i, ln in enumerate(lines) if (d, i, words(ln)) not in gone]
        want.append((d is not None, d or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.remove_similar_lines(odd).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert next(r for r in got if r.doc_id == 17).kept_text == "\n\nline a b c d e\nline a b c d f\n"


@pytest.mark.parametrize("hot", [1, 64])
def test_line_dedup_in_a_large_family(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(4)
    base = sentence(r, 40).split()
    rows = []
    for i in range(120):
        lines = []
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(0, 7)):
                w[r.randrange(40)] = sentence(r, 1)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    gone = cut_lines(rows, 80)
    got = line_dedup.remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_removed for x in got} == {d: sum(g[0] == d for g in gone) for d, _ in rows}


@pytest.mark.parametrize("run", [near_dup.near_duplicates, suffix_dedup.remove_repeated_bytes, recompression.remove_repeated_substrings, line_dedup.remove_similar_lines])
def test_empty_tables(none, run):
    assert run(none).collect() == []


def test_digests_are_of_what_is_kept(odd):
    from pyspark.sql import functions as F

    got = recompression.remove_repeated_substrings(odd).select("kept_text", F.sha2("kept_text", 256).alias("h")).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.h for r in got)


def test_occurrences_of_a_large_batch_go_out_in_parts(spark):
    texts = [sentence(random.Random(i), 3000) for i in range(200)]
    asked = [[{"sym": i, "first": 0, "n": 1, "off": 0}] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts), pa.array(asked)], ["doc_id", "tid", "text", "asked"])
    parts = list(context_batches([batch, batch.slice(0, 0)], lambda text, asked: [text[:8]] * len(asked)))
    assert len(parts) > 8 and [x for p in parts for x in p.column(1).to_pylist()] == list(range(len(texts)))
    assert [x for p in parts for x in p.column(5).to_pylist()] == [t[:8].encode() for t in texts]


def test_recompression_takes_small_batches(spark, odd):
    recompression.remove_repeated_substrings(odd).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_contexts_are_hashed_by_parts_and_not_by_documents(monkeypatch):
    from lexiloom.llm import recompression as rc

    made = []

    class Counted(rc.Rolling):
        def __init__(self, values):
            made.append(len(values))
            super().__init__(values)

    monkeypatch.setattr(rc, "Rolling", Counted)
    texts = [" ".join(f"w{(i * j) % 97}" for i in range(60 + j)) for j in range(40)]
    asked = [[{"sym": j, "first": f, "n": 11, "off": 20} for f in (0, j)] if j > 10 else [] for j in range(40)]
    kind = pa.list_(pa.struct([("sym", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array(texts), pa.array(asked, kind)], ["doc_id", "tid", "text", "asked"])
    rows = pa.Table.from_batches(list(rc._contexts(50)([batch]))).to_pylist()
    assert len(made) == 1 and [(r["doc_id"], r["first"]) for r in rows] == [(j, f) for j in range(11, 40) for f in (0, j)]
    for r in rows:  # offsets 10 to 20 lie in two intervals of 16
        roll, at = Counted(rc.WordHashes().of(texts[r["doc_id"]].encode().split())), r["first"]
        first, core = np.arange(at, at + 11), at + 20 - np.array([0, 16])
        assert r["bytes"] == roll.of(first, first + 50).tobytes() + roll.of(core, core + 35).tobytes()


def test_pairs_of_a_dense_region_come_up_once(spark):
    base, saved = [f"w{i}" for i in range(120)], {}

    class Seen(Scratch):
        def save(self, df, name):
            saved[name] = df, super().save(df, name)
            return saved[name][1]

    # One word in other places: similar to the base, not to each other; in the same place: similar.
    texts = [" ".join([*base[:k], f"x{j}", *base[k + 1 :]]) for k in range(10, 110, 8) for j in (k, k + 500)[: 1 + k % 3]]
    scratch = Seen(spark, "dense-test")
    sets = scratch.save(spark.createDataFrame(list(enumerate(texts)), "node long, text string").mapInArrow(near_dup._gram_sets(5), "node long, n long, grams array<long>, bits array<long>"), "sets")

    def merged(comp, links, name):
        stars = comp.where("node != component").select(comp.node.alias("a"), comp.component.alias("b"))
        return scratch.save(near_dup.connected_components(stars.unionByName(links), scratch, f"cc-{name}"), f"components-{name}")

    comp = near_dup.dense_links(sets, spark.createDataFrame([], "node long, component long"), merged, scratch, 85)
    want = [c for c in components(list(enumerate(texts)), 85)]
    got = {r.node: r.component for r in comp.collect()}
    assert len({got.get(i, -1 - i) for i in range(len(texts))}) == len(set(want)) < len(texts)
    plan, table = saved["dense-pairs-2"]
    rows = [(r.a, r.b) for r in table.collect()]
    assert len(rows) > 20 and len(rows) == len(set(rows)) and "Aggregate" not in plan._jdf.queryExecution().optimizedPlan().toString()
