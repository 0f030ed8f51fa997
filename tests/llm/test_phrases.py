"""Periodic runs, fingerprints and collocations against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.llm import collocations as co
from lexiloom.llm import periodic_runs as pr
from lexiloom.llm import winnowing as wn
from lexiloom.llm.queries import op11_periodic_runs, op12_fingerprints
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs --------------------------------------------------------------------------------------------------


def plain_runs(words, least):
    """(start, end, smallest period): for each period the stretches in which words that far apart are equal."""
    found: dict = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


short = st.lists(st.integers(0, 2), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(short, st.integers(1, 5)), max_size=5), min_size=1, max_size=4), st.sampled_from([2, 3, 4, 6, 12]))
def test_runs_are_those_of_brute_force(docs, least):
    docs = [[w for part, n in d for w in part * n] for d in docs]
    assert pr.find_runs(docs, least) == [plain_runs(d, least) for d in docs]


@pytest.mark.parametrize("words", [["a"] * 50_000, [str(i % 7) for i in range(50_000)], [str(i * i % 9973) for i in range(50_000)]])
def test_runs_of_long_texts(words):
    found = pr.find_runs([words], 12)[0]
    assert all(words[i] == words[i + p] for s, e, p in found for i in range(s, e - p))
    assert len(found) == (1 if len(set(words)) < 10 else len(found))


def test_runs_of_odd_rows(spark, odd, none):
    assert pr.periodic_runs(none).collect() == []
    rows = {(r.doc_id, r.n_words, r.kept_text): [tuple(x) for x in r.runs] for r in pr.periodic_runs(odd, least=4).collect()}
    want = {}
    for r in odd.collect():
        words = WORD.findall(r.text or "")
        runs = plain_runs(words, 4) if len(words) < 2000 else pr.find_runs([words], 4)[0]
        gone = {i for s, e, p in runs for i in range(s + p, e)}
        want[r.doc_id, len(words), " ".join(w for i, w in enumerate(words) if i not in gone)] = [(s, e - s, p) for s, e, p in runs]
    assert rows == want
    assert pr.periodic_runs(odd).count() == odd.count()
    assert pr.periodic_runs(odd.drop("source", "lang", "n_chars")).count() == odd.count()
    with pytest.raises(ValueError):
        pr.periodic_runs(odd, least=1)


def looped(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_runs(spark, tmp_path, odd):
    rows = [(i, " ".join(f"w{(i * k * k) % 31}" for k in range(i % 90))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.where("doc_id is null or doc_id < 12").select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = 0
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(looped(r.doc_id, r.text))
    for r in op11_periodic_runs(spark, str(tmp_path)).collect():
        want = []
        for words in texts[r.doc_id]:
            runs = plain_runs(words, 12)
            lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
            gone = {i for s, e, p in runs for i in range(s + p, e)}
            best = min(((s - e, s, p) for s, e, p in runs), default=None)
            own = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            want.append((len(runs), *own, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
        seen += r.n_runs
        assert tuple(r)[1:] in want
    assert seen > 10


# --- fingerprints ---------------------------------------------------------------------------------------------------


def plain_print(text, gram=wn.GRAM, window=wn.WINDOW):
    """[(hash, position)] of the rightmost least hash of each window."""
    units = [zlib.crc32(u.encode()) for u in re.findall(wn.UNIT, text or "")]

    def fold(xs):
        h = 0
        for x in xs:
            h = (h * wn.BASE + x) % wn.PRIME
        return h

    grams = [fold(units[i : i + gram]) for i in range(len(units) - gram + 1)] or ([fold(units)] if units else [])
    picked = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        own = grams[i : i + window]
        at = max(j for j, x in enumerate(own) if x == min(own)) + i
        if not picked or picked[-1][1] != at:
            picked.append((grams[at], at))
    return picked


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def cut_key(row):
    return (row.doc_id is None, -(row.doc_id or 0))


@pytest.mark.parametrize(("gram", "window"), [(4, 8), (3, 5), (1, 1), (7, 6), (2, 16)])
def test_fingerprints_are_those_of_brute_force(spark, odd, gram, window):
    rows = wn.fingerprinted(odd.select("doc_id", "text"), "text", "f", gram, window).select("text", wn.spread(F.col("f")).alias("f")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert [tuple(x) for x in r.f] == plain_print(r.text, gram, window)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), min_size=11, max_size=14), st.lists(st.sampled_from("efgh"), max_size=20))
def test_a_shared_stretch_is_found(before, shared, after):
    a, b = " ".join(before + shared + after), " ".join(after + shared + before)
    assert {h for h, _ in plain_print(a)} & {h for h, _ in plain_print(b)}


def test_comparison_with_the_next_document(spark, odd, none):
    assert wn.compared_with_next(none).collect() == []
    # Ids that repeat have their order from a hash of Spark's; they are left out here and come below.
    ids = Counter(r.doc_id for r in odd.collect())
    rows = odd.where(F.col("doc_id").isin([i for i, n in ids.items() if n == 1]))
    want = sorted(rows.collect(), key=cut_key)
    got = sorted(wn.compared_with_next(rows).collect(), key=cut_key)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        text, then = w.text or "", want[(i + 1) % len(want)].text or ""
        edited = text[: len(text) - len(text) // 2] + then[: len(text) // 2]
        assert (g.n_chars, g.edited) == (len(text), edited)
        assert g.near_edited == like(plain_print(text), plain_print(edited)) and g.near_next == like(plain_print(text), plain_print(then))
    assert wn.compared_with_next(odd).count() == odd.count()
    one = wn.compared_with_next(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited == "a ba " and one[0].near_next == 1.0


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(wn, "BUCKET_ROWS", 3)
    rows = [(None if i % 10 == 0 else i * 7 % 500, f"t{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = wn.with_next(docs, lambda d: d, ["doc_id", "text"]).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    following = {r.text: r.next_text for r in got}
    own, seen = max((r for r in rows if r[0] is not None))[1], []
    for _ in rows:  # one ring through all rows, by descending id, missing ones last
        seen.append(own)
        own = following[own]
    of = {t: i for i, t in rows}
    ids = [of[t] for t in seen]
    assert len(set(seen)) == len(rows) and ids[:180] == sorted((i for i in ids if i is not None), reverse=True) and ids[180:] == [None] * 20


def test_query_of_fingerprints(spark, tmp_path, odd):
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_fingerprints(spark, str(tmp_path)).collect()
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(",".join(f"{h:x}:{p}" for h, p in plain_print(r.text)))
    assert len(rows) == odd.count() and all(r.fingerprint in texts[r.doc_id] and 0 <= r.near_edited <= 1 for r in rows)


# --- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, words, least, inside, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(ws)
            for k in range(1, words + 1):
                count.update((lang or "und", tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = defaultdict(list)
    long = [(g, p, n) for (g, p), n in count.items() if len(p) > 1 and n >= least]
    holds = defaultdict(int)
    for g, p, n in long:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                holds[g, p[i : i + k]] = max(holds[g, p[i : i + k]], n)
    for g, p, a in long:
        if 100 * holds[g, p] >= inside * a:
            continue
        score, cut = min((1_000_000 * a * a // (count[g, p[:k]] * count[g, p[k:]]), k) for k in range(1, len(p)))
        found[g].append((-score, -a, " ".join(p).encode(), count[g, p[:cut]], count[g, p[cut:]]))
    return sorted((g, i, p.decode(), -a, x, y, total[g], -s) for g, own in found.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


def columns(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("words", "least", "inside", "top", "bits", "stretch"), [(3, 2, 50, 2000, 26, 1 << 22), (3, 2, 50, 7, 3, 40), (4, 2, 80, 2000, 5, 200), (2, 1, 50, 2000, 20, 1000), (5, 3, 1, 2000, 16, 100)])
def test_collocations_are_those_of_brute_force(spark, odd, words, least, inside, top, bits, stretch):
    texts = ["the big red dog. The big red cat, the big cat", "a a a a a a", "to be or not to be; to be", "x\ty X Y\nx y", "Über den Über den", "de la. de la de la", "a-b c'd a-b c'd"]
    rows = [(("en", "fr", None)[i % 3], t) for i, t in enumerate(texts * 3)]
    docs = odd.where("length(text) < 100000 or text is null").select("lang", "text").unionByName(spark.createDataFrame(rows, "lang string, text string"))
    got = columns(co.collocations(docs, words, least, inside, top, bits=bits, stretch=stretch))
    assert got == plain_collocations([tuple(r) for r in docs.collect()], words, least, inside, top) and got


def test_collocations_of_nothing(spark, odd, none):
    assert co.collocations(none).collect() == []
    assert co.collocations(odd.where("text is null")).collect() == []


def test_counts_beyond_64_bits(spark):
    """Scores come from products that a long can't hold."""
    rows = spark.createDataFrame([(10**10, [10**10 + 7], [10**10 + 9])], "n long, firsts array<long>, rests array<long>")
    best = rows.select(co._lowest_cut(2).alias("b")).first().b
    assert best.score == 1_000_000 * 10**20 // ((10**10 + 7) * (10**10 + 9))


def test_a_shared_name_starts_anew(spark, monkeypatch):
    """The first seed is taken to have clashed."""
    seeds, levels = [], co._levels
    monkeypatch.setattr(co, "_levels", lambda docs, words, least, seed, *rest: seeds.append(seed) if seed == 0 else levels(docs, words, least, seed, *rest))
    docs = spark.createDataFrame([("en", "a b c. a b")] * 5, "lang string, text string")
    assert [r.phrase for r in co.collocations(docs, least=5).orderBy("rank").collect()] == ["a b c"] and seeds == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1))
def test_a_name_and_its_left_parent_give_the_right_one(pairs):
    left, right = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    assert (co.right_of(co.pair_names(left, right), left) == right).all()
