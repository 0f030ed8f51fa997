"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: the trigrams that every match must contain.
The index maps each trigram that some rule asks for to the documents that contain it; a rule's candidates are the
documents in the intersection (or union) of its postings, and only those are matched against the expression. Rules
without mandatory trigrams are matched against every document.

All matching is done by Spark's own expressions. Positions are running sums of the lengths of the matches and of the
pieces between them, taken over rows, so a text with very many matches costs no more than in proportion.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    Where only runs of a length count, that length stands in the pattern: a run that is too short holds no match, so
    the matches are those of the open pattern that are long enough.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query is True (anything may match), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
_MANY = 32


def _join(kind: str, parts: list[Query]) -> Query:
    idle = kind == "and"
    if any(p is (not idle) for p in parts):
        return not idle
    parts = list(dict.fromkeys(p for p in parts if p is not idle))
    return idle if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """Any of these strings occurs; one that contains another adds nothing."""
    strings = {s for s in strings if not any(t != s and t in s for t in strings)}
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that match, if they are few; what every match contains)"""
    done: list[Query] = []
    run, whole = {""}, True
    for op, arg in items:
        exact, must = None, True
        if op is rc.LITERAL:
            exact = {chr(arg).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            exact = {chr(a).lower() for _, a in arg}
        elif op is rc.SUBPATTERN:
            exact, must = _walk(arg[3])
        elif op is rc.BRANCH:
            found = [_walk(b) for b in arg[1]]
            exact = None if any(e is None for e, _ in found) else set().union(*[e for e, _ in found])
            must = _join("or", [m for _, m in found])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, body = arg
            e, m = _walk(body)
            if e is not None and most == 1:
                exact = e | {""} if least == 0 else e
            must = m if least else True
        if exact is not None and len(exact) * len(run) <= _MANY:
            run = {a + b for a in run for b in exact}
        else:
            done += [_of_strings(run), must if exact is None else _of_strings(exact)]
            run, whole = {""}, False
    return (run, _of_strings(run)) if whole else (None, _join("and", [*done, _of_strings(run)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every match of ``pattern`` meets."""
    return _walk(rp.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if isinstance(query, bool) else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: Query, present) -> F.Column:
    if isinstance(query, bool):
        return F.lit(query)
    if isinstance(query, str):
        return F.array_contains(present, query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(p, present) for p in query[1]])


def trigram_index(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """(trigram, doc_id, tid): postings of the wanted trigrams, ASCII letters in lower case."""
    low = docs.select("doc_id", "tid", F.lower("text").alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted)]), lambda t: t.isNotNull())
    return low.select("doc_id", "tid", found.alias("found")).select("doc_id", "tid", F.explode("found").alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, tid, kinds): the documents in the postings that each rule's query asks for."""
    postings = trigram_index(docs, set().union(*map(trigrams, queries.values())))
    have = postings.groupBy("doc_id", "tid").agg(F.collect_set("trigram").alias("present"))  # no more than the rules' trigrams
    kinds = F.filter(F.array(*[F.when(_holds(q, F.col("present")), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return have.select("doc_id", "tid", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _pieces(text, rule: Rule) -> F.Column:
    """For each match of a rule: the lengths of the piece before it, of the match, and of the group that counts."""
    pattern = F.lit(rule.pattern)
    match = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    picked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else match
    piece = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(match))
    return F.when(F.regexp_like(text, pattern), F.arrays_zip(piece.alias("p"), match.alias("m"), picked.alias("g"))).otherwise(F.array().cast("array<struct<p:int,m:int,g:int>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (start, rank, end).

    start and end are code points, end exclusive; rank is the rule's place in ``rules``. Spans are sorted by start and
    rank. Matches are leftmost and non-overlapping within each rule, and a match that is too short still uses up its
    text. A missing text counts as empty. Rows are told apart by doc_id and a hash of the text, so a shared or missing
    doc_id is no matter and repeated rows get the same spans. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    of = lambda df, *cols: df.select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), *cols).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tid") == F.col("_tid"))
    found = []
    if indexed:
        texts = docs.join(of(candidates(docs, indexed), "kinds"), same)
        one = texts.groupBy("doc_id", "tid").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds"))  # repeated rows once
        none = F.array().cast("array<struct<p:int,m:int,g:int>>")
        parts = [F.when(F.array_contains("kinds", r.kind), _pieces(F.col("text"), r)).otherwise(none) for r in rules if r.kind in indexed]
        found.append((one, [i for i, r in enumerate(rules) if r.kind in indexed], parts))
    whole = [i for i, r in enumerate(rules) if queries[r.kind] is True]
    if whole:
        some = reduce(lambda a, b: a | b, [F.regexp_like("text", F.lit(rules[i].pattern)) for i in whole])
        found.append((docs.where(some).dropDuplicates(["doc_id", "tid"]), whole, [_pieces(F.col("text"), rules[i]) for i in whole]))
    spans = None
    for texts, ranks, parts in found:
        by_rule = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), p.alias("pieces")) for i, p in zip(ranks, parts, strict=True)])).alias("rule")
        rows = texts.select("doc_id", "tid", by_rule).select("doc_id", "tid", "rule.rank", F.posexplode("rule.pieces").alias("i", "x"))
        upto = F.sum(F.col("x.p") + F.col("x.m")).over(Window.partitionBy("doc_id", "tid", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
        least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
        rows = rows.withColumn("end", upto).where(F.col("x.g") >= least)
        rows = rows.select("doc_id", "tid", F.struct((F.col("end") - F.col("x.m")).alias("start"), "rank", "end").alias("span"))
        spans = rows if spans is None else spans.unionByName(rows)
    if spans is None:
        return docs.select("doc_id", F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("spans"))
    spans = spans.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    out = docs.select("doc_id", "tid").join(of(spans, "spans"), same, "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("spans"))


def described(spans, rules: tuple[Rule, ...] = BASE + MORE) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
