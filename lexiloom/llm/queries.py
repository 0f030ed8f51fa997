"""One query per operator, over whole tables with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import quality_cnn, secret_scan, winnowing
from .collocations import collocations
from .decontam import contaminated
from .hamming_search import sign_codes, top_k
from .line_dedup import remove_similar_lines
from .mixing import mix_sources
from .near_dup import near_duplicates
from .periodic_runs import periodic_runs, with_looped_ends
from .recompression import remove_repeated_substrings
from .sharding import shard
from .suffix_dedup import remove_repeated_bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("tid")


def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(_table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("vec_id % 100 = 0"), k=10)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_similar_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(_table(spark, sf_dir, "documents"), width=200, keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality_cnn.classify(docs, quality_cnn.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), shards=8)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_substrings(_table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    n = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE))
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)],
        F.sha2(secret_scan.described(base), 256).alias("base_sha256"),
        secret_scan.described(F.col("spans")).alias("spans"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_looped_ends(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    length, period = best["length"], -best["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compared_with_next(_table(spark, sf_dir, "documents"))
    prints = [winnowing.described(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).drop("cut")


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_hamming_search, op3_line_dedup, op4_suffix_dedup, op5_quality_cnn, op6_sharding, op7_mixing, op8_recompression, op9_decontam, op10_secret_scan, op11_periodic_runs, op12_fingerprints, op13_collocations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _secrets_sql() -> str:
    """Every rule over every text: pieces between the matches tell the positions."""
    parts = []
    for rank, r in enumerate(secret_scan.BASE + secret_scan.MORE):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""select doc_id, {rank} k, '{r.kind}' kind, list_sum(list_transform(pc[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0) s, length(m[i]) l
  from (select doc_id, m, g, pc, unnest(range(1, len(m) + 1)) i from (select doc_id, regexp_extract_all(t, {p}, 0) m, regexp_extract_all(t, {p}, {r.group}) g, regexp_split_to_array(t, {p}) pc from d)) where length(g[i]) >= {r.least}""")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents), s as ({" union all ".join(parts)}),
x as (select doc_id, k, s, kind || ':' || s::bigint || ':' || (s + l)::bigint v from s),
a as (select doc_id, count(*) filter (k = 0) a0, count(*) filter (k = 1) a1, count(*) filter (k = 2) a2,
  coalesce(string_agg(v, ',' order by s, k) filter (k < 3), '') base, string_agg(v, ',' order by s, k) spans from x group by doc_id)
select doc_id, coalesce(a0, 0) n_assign, coalesce(a1, 0) n_access, coalesce(a2, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)"""


_P, _B = winnowing.PRIME, winnowing.BASE
_B2 = pow(_B, 2, _P)

#: CRC-32 in SQL: its table of 256 entries from the rule, and the fold over a text's bytes, given in hexadecimal.
_CRC_TABLE = """bits(k, b, c) as (select range, 0, range::bigint from range(256) union all
  select k, b + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where b < 8),
tab as (select list(c order by k) t from bits where b = 8)"""


def _crc32(x: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length({x})::bigint // 2), lambda i: ('0x' || substr({x}, 2 * i + 1, 2))::bigint)),
    lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295)"""


ORACLES = {
    "op1_near_dup": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
sh as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end s from w),
e as (select doc_id, len(s) n, unnest(s) x from sh),
p as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
q as (select a, b from p union all select b, a from p),
r as (select doc_id d, doc_id c from sh union select b, c from r join q on q.a = r.d where c < b),
m as (select d, min(c) c from r group by d)
select sh.doc_id, len(s)::bigint n_shingles, c component_id, c = sh.doc_id kept from sh join m on m.d = sh.doc_id""",
    "op2_hamming_search": """
with b as (select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) b from embeddings),
p as (select q.vec_id query_id, e.vec_id, list_sum(list_transform(range(1, len(e.b) + 1), lambda i: abs(q.b[i] - e.b[i])))::int distance
  from b q, b e where q.vec_id % 100 = 0)
select query_id, rank::int rank, vec_id, distance from (select *, row_number() over (partition by query_id order by distance, vec_id) rank from p) where rank <= 10""",
    "op3_line_dedup": r"""
with l as (select doc_id, unnest(range(len(x))) i, unnest(x) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents)),
t as (select doc_id, i, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) w from l),
s as (select array_to_string(w, ' ') k, any_value(w) w, any_value(len(w)) n, min(doc_id * 1000000 + i) f from t where len(w) > 0 group by all),
u as (select k, n, f, unnest(w) x from s),
df as (select x, count(*) c from u group by x),
r as (select k, n, f, x, row_number() over (partition by k order by c, x) p from u join df using (x)),
pre as (select * from r where p <= n - (80 * n + 99) // 100 + 1),
c as (select distinct a.k ka, b.k kb from pre a join pre b on a.x = b.x and b.f < a.f and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
v as (select distinct ka k from (select ka, a.w wa, b.w wb from c join s a on a.k = ka join s b on b.k = kb)
  where 100 * len(list_intersect(wa, wb)) >= 80 * (len(wa) + len(wb) - len(list_intersect(wa, wb)))),
g as (select doc_id, i, line, len(t.w) > 0 and (v.k is not null or doc_id * 1000000 + i > f) gone from t left join s on s.k = array_to_string(t.w, ' ') left join v on v.k = s.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from g group by doc_id""",
    "op4_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
p as (select doc_id, unnest(range(0, length(x)::bigint // 2 - 199)) i, x from d),
h as (select doc_id, i, md5(substr(x, 2 * i + 1, 400)) h from p),
f as (select doc_id, i from h where h in (select h from h group by h having count(*) > 1)),
g as (select *, sum(far) over (partition by doc_id order by i) run from
  (select *, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end far from f)),
s as (select doc_id, run, min(i) a, max(i) + 200 z from g group by doc_id, run),
k as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) y from s),
r as (select doc_id, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' order by a) part, max(z) z, sum(z - a) gone, count(*) n
  from k join d using (doc_id) group by doc_id)
select doc_id, length(x)::bigint // 2 n_bytes, coalesce(gone, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans,
  sha256(unhex(case when z is null then x else part || substr(x, 2 * z + 1) end)) kept_sha256
from d left join r using (doc_id)""",
    "op6_sharding": r"""
with recursive bits(k, b, c) as (select range, 0, range::bigint from range(256) union all
  select k, b + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where b < 8),
tab as (select list(c order by k) t from bits where b = 8),
d as (select doc_id, text, hex(encode(coalesce(text, ''))) x from documents),
r as (select doc_id, length(x)::bigint // 2 + 1 size, coalesce(md5(text), '') digest, md5(coalesce(doc_id::varchar, ''))[:2] part,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x)::bigint // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) text_crc32 from d, tab),
g as (select digest, sum(size) bytes, sum(sum(size)) over (order by digest)::bigint upto from r group by digest),
u as (select list(upto order by upto) u, max(upto)::bigint total, max(bytes)::bigint widest from g),
bs(lo, hi) as (select greatest((total + 7) // 8, widest), (total + 7) // 8 + widest from u union all
  select case when ok then lo else mid + 1 end, case when ok then mid else hi end from (select lo, hi, (lo + hi) // 2 mid,
    list_reduce(list_prepend(0::bigint, range(8)), lambda a, i: coalesce(list_max(list_filter(u, lambda v: v <= a + (lo + hi) // 2)), a)) >= total ok
    from bs, u where lo < hi)),
cap as (select min(hi) c from bs where lo = hi),
ends(k, e) as (select 0, list_max(list_filter(u, lambda v: v <= c)) from u, cap union all
  select k + 1, list_max(list_filter(u, lambda v: v <= e + c)) from ends, u, cap where k < 7),
s as (select digest, (select min(k) from ends where upto <= e) shard from g)
select doc_id, size, text_crc32, 'bytes' law, shard::int shard,
  row_number() over (partition by shard order by digest, part, doc_id) - 1 slot, null::int grown_shard from r join s using (digest)""",
    "op7_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  -ln((('0x' || md5(coalesce(doc_id::varchar, md5(text), ''))[:12])::bigint + 0.5::double) / 281474976710656::double) / (0.1::double + 0.9::double *
    coalesce(length(regexp_replace(coalesce(text, ''), '[^\p{L}0-9 \n.,]', '', 'g'))::double / nullif(length(coalesce(text, '')), 0)::double, 0)) k from documents),
s as (select source, sum(size)::bigint source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w from d group by source),
f as (select *, source_size * 3.0::double / w full_at from s),
l as (select *, (sum(source_size) over () - coalesce(sum(source_size) over (order by full_at, source rows between unbounded preceding and 1 preceding), 0) * 3.0::double)::double
  / sum(w) over (order by full_at, source rows between current row and unbounded following) level from f),
t as (select source, source_size, case when full_at < v then source_size * 3.0::double else v * w end target
  from l, (select arg_min(level, full_at) v from l where level <= full_at)),
e as (select *, floor(target / nullif(source_size, 0)::double)::int ep from t),
c as (select doc_id, d.source, size, source_size, target, coalesce(ep, 0) ep, coalesce(sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) b
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, size * (ep + case when target - ep * source_size > 0 and b + size / 2.0::double <= target - ep * source_size then 1 else 0 end) taken from c""",
    "op8_recompression": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 48)) i, unnest(list_transform(range(1, len(ws) - 48), lambda j: md5(array_to_string(ws[j:j+49], ' ')))) h from w),
low as (select h, min(doc_id) d from win group by h having min(doc_id) < max(doc_id)),
gone as (select doc_id, list(distinct i + o) g from win join low using (h), range(0, 50) t(o) where doc_id > d group by doc_id),
k as (select doc_id, len(ws) n, coalesce(len(g), 0) r,
  case when g is null then ws else list_filter(ws, lambda x, i: not list_contains(g, i)) end kept from w left join gone using (doc_id))
select doc_id, n::bigint n_words, r::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k""",
    "op9_decontam": rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
iw as (select item_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from benchmark),
ds as (select doc_id, len(ws) n, unnest(range(0, len(ws) - 4)) p, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) s from dw),
i1 as (select item_id, len(ws) m, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) s from iw),
it as (select item_id, m, s, count(*) c from i1 group by all),
st as (select distinct doc_id, item_id, least(m, n) - 4 span, m - 4 own, greatest(p - o, 0) a
  from ds join it using (s), range(0, 400) t(o) where o < least(m, n) - 4 and greatest(p - o, 0) <= n - least(m, n)),
wc as (select st.*, s, count(*) c from st join ds on ds.doc_id = st.doc_id and p >= a and p < a + span group by all),
j as (select doc_id, item_id, a, span, own, sum(least(wc.c, it.c)) b from wc join it using (item_id, s) group by all),
r as (select *, row_number() over (partition by doc_id, item_id order by b::double / (span + own - b) desc, a) k
  from j where 100 * b >= 80 * (span + own - b))
select doc_id, item_id, a::bigint start_word, (span + 4)::bigint n_words, b::double / (span + own - b)::double similarity from r where k = 1""",
    "op10_secret_scan": _secrets_sql(),
    "op11_periodic_runs": rf"""
with recursive {_CRC_TABLE},
d as (select doc_id, {_crc32("hex(encode(doc_id::varchar))")} h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents, tab),
c as (select doc_id, ws, len(ws)::bigint n, h % 10 = 0 and len(ws) > 0 looped, (h // 10) % greatest(len(ws), 1) a, h // 10 g from d),
x as (select doc_id, n, case when looped then ws[:a] || list_transform(range(0, n - a), lambda i: ws[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) else ws end ws from c),
w as (select doc_id, unnest(range(n)) i, unnest(ws) w from x),
e as (select doc_id, a.i, b.i - a.i q from w a join w b using (doc_id, w) where b.i > a.i),
s as (select doc_id, q, min(i) s, count(*) c from (select *, i - row_number() over (partition by doc_id, q order by i) t from e) group by doc_id, q, t),
r as (select doc_id, s, c + q l, min(q) q from s where c >= q and c + q >= 12 group by doc_id, s, c + q),
best as (select doc_id, count(*) k, max({{'l': l, 's': -s, 'q': -q}}) b, string_agg(s::bigint || ',' || l::bigint || ',' || q::bigint || chr(10), '' order by s, q) t from r group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) i from r),
kept as (select doc_id, string_agg(w, ' ' order by i) t from w anti join gone using (doc_id, i) group by doc_id)
select x.doc_id, coalesce(k, 0)::bigint n_runs, (-b.s)::bigint as start, b.l::bigint as length, (-b.q)::bigint period,
  (b.l * 1000 // -b.q)::bigint exponent_milli, sha256(coalesce(best.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from x left join best using (doc_id) left join kept using (doc_id)""",
    "op12_fingerprints": rf"""
with recursive {_CRC_TABLE},
o as (select doc_id, coalesce(text, '') t, row_number() over (order by doc_id desc) k from documents),
d as (select o.doc_id, o.t, left(o.t, length(o.t) - length(o.t) // 2) || left(nx.t, length(o.t) // 2) e, nx.doc_id next_id
  from o join o nx on nx.k = o.k % (select count(*) from o) + 1),
u as (select doc_id, z, regexp_extract_all(t, '[^\x20\x09-\x0D]{{1,16}}') us from (select doc_id, 0 z, t from d union all select doc_id, 1, e from d)),
r as (select doc_id, z, unnest(range(len(us))) i, unnest(us) w from u),
c as (select w, {_crc32("hex(encode(w))")} h from (select distinct w from r), tab),
hs as (select doc_id, z, list(h order by i) h from r join c using (w) group by doc_id, z),
g as (select doc_id, z, case when len(h) < 4 then [list_reduce(list_prepend(0::bigint, h), lambda a, x: (a * {_B} + x) % {_P})]
  else list_transform(range(1, len(h) - 2), lambda i: ((h[i] * {_B} + h[i+1]) % {_P} * {_B2} + (h[i+2] * {_B} + h[i+3]) % {_P}) % {_P}) end g from hs),
v as (select doc_id, z, list_transform(g, lambda x, i: x * 4294967296 + (4294967296 - i)) v from g),
m as (select doc_id, z, list_distinct(case when len(v) <= 8 then [list_min(v)] else list_transform(range(1, len(v) - 6), lambda i: list_min(v[i:i+7])) end) m from v),
f as (select u.doc_id, u.z, coalesce(list_sort(list_transform(m, lambda x: {{'p': 4294967295 - x % 4294967296, 'h': x // 4294967296}})), []) f,
  coalesce(list_distinct(list_transform(m, lambda x: x // 4294967296)), []) hh from u left join m using (doc_id, z)),
s as (select doc_id, z, array_to_string(list_transform(f, lambda x: lower(hex(x.h)) || ':' || x.p::bigint), ',') s, hh from f),
j as (select d.doc_id, length(d.t)::bigint n_chars, sha256(d.e) edited_sha256, a.s fingerprint, b.s edited_fingerprint, a.hh x, b.hh y, n.hh z
  from d join s a on a.doc_id = d.doc_id and a.z = 0 join s b on b.doc_id = d.doc_id and b.z = 1 join s n on n.doc_id = d.next_id and n.z = 0)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  case when len(x) + len(y) = 0 then 1.0::double else len(list_intersect(x, y))::double / (len(x) + len(y) - len(list_intersect(x, y)))::double end near_edited,
  case when len(x) + len(z) = 0 then 1.0::double else len(list_intersect(x, z))::double / (len(x) + len(z) - len(list_intersect(x, z)))::double end near_next from j""",
    "op13_collocations": rf"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') ws from p),
f as (select lang, k, g, count(*) f from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i+k-1])) g from w, range(1, 4) t(k)) group by all),
c as (select * from f where k > 1 and f >= 10),
y as (select *, g[:j] lg, g[j+1:] rg from c, range(1, 3) t(j) where j < k),
x as (select y.lang, y.k, y.g, y.f a, j, l.f l, r.f r, (1000000::hugeint * y.f * y.f) // (l.f::hugeint * r.f) score
  from y join f l on l.lang = y.lang and l.g = lg join f r on r.lang = y.lang and r.g = rg),
b as (select *, row_number() over (partition by lang, g order by score, j) z from x),
h as (select lang, g, max(f) f from (select lang, g[:2] g, f from c where k = 3 union all select lang, g[2:] g, f from c where k = 3) group by all),
o as (select b.lang, array_to_string(b.g, ' ') phrase, a, l, r, score from b left join h on h.lang = b.lang and h.g = b.g where z = 1 and coalesce(100 * h.f < 50 * a, true)),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score::bigint score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from o) join n using (lang) where rank <= 2000""",
}
