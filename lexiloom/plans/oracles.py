"""SQL twins of the registered queries.

Tokens are told here by one leftmost-first expression for the characters that the driver's tables hold, where the
engine takes the longest of many patterns.
"""

from __future__ import annotations

from ..functions import charsets, lexicons
from ..operators import properties
from . import cases

# Fixed values, stated here anew so that a wrong list of the engine's shows.
_V = "aeiouyáéíóúàèìòùäëïöüâêîôûāēīōūAEIOUYÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛĀĒĪŌŪ"
ABBREVIATIONS = """
A Adj Adm Adv Apr Asst Aug B Bart Biol Bldg Brig Bros C Capt Cell Cf Ch Chem Chs Cmdr Co Col Comdr Con Corp
Cpl D DR Dec Dem Dept Depts Dr Drs E Ed Eds Eg Ens Eq Eqs Etc Ex F Feb Fig Figs G Gen Gov H Hon Hosp I Ie Inc
Ins Insp J Jan Jr Jul Jun K L Lt M MM MR MRS MS Maj Mar Messrs Miss Mlle Mme Mol Mr Mrs Ms Msgr N No Nos Nov O
Oct Op Ord P Pfc Ph Prof Pvt Q R Ref Refs Rep Reps Res Rev Rt S Sec Secs Sen Sens Sep Sept Sfc Sgt Sr St Supt
Surg T U Univ V Viz Vol Vols Vs W X Y Z apr aug cf ch chs dec dept depts ed eds eg eq eqs est et al etc ex feb
fig figs ie jan jr jul jun mar mi no nos nov oct p pp ref refs repr rev sec secs sep sept trans v viz vol vols
vs Éd éd
"""

_A, _L = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[A-Za-zÀ-ÖØ-öø-ÿ0-9]"
_C = rf"(?:(?:''|-|\.-?|&){_L}+)"
_EMAIL = rf"\S+@\S+\.{_A}+"
_URI = r"(?:[wW]{3}\.|[fF][tT][pP]\.)\S+\.[A-Za-z]+\S*|[A-Za-z]+://\S+[A-Za-z0-9/]"
_ABBR = rf"{_A}{{1,2}}(?:\.-?{_A})+"
_NUM = r"[-+]?[0-9]+[.,][0-9]+(?:(?:[.,]| +)[0-9]+)*|(?:\+[0-9]+ ?)?(?:(?:-|/)?(?:[0-9]+|\([0-9]+\)) ?)+[0-9]+|[-+]?[0-9]+(?:(?:[.,]| +)[0-9]+)*|[0-9]+:[0-9]+"
_SYM = r"\.\.+|\?+|!+|-+|\++|\*+|/+|=+|>>|<<|>=|<=|``|''''|[,;:!?.''\"()\[\]{}$£€©^%&~<>]"
_RX = "|".join([
    _EMAIL, _URI, rf'"{_L}+{_C}*"-{_L}+{_C}*', rf"\({_A}{_L}*\)-?{_L}+{_C}*", rf"{_L}+{_C}*-?\({_A}{_L}*\)(?:-?{_L}+{_C}*)?",
    rf"{_A}{{1,2}}(?:\.-?{_A})*\.-?(?:{_L}{_L}+|[0-9]){_C}*", rf"{_A}{{1,2}}(?:\.-?{_A})+(?:''|-|&){_L}+{_C}*", _ABBR,
    rf"{_L}*{_A}{_L}*{_C}*|{_L}+{_C}*(?:-|\.-?|&|''){_L}*{_A}{_L}*{_C}*", _NUM, _SYM,
    rf"[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9,;:!?.''\"()\[\]{{}}$£€©^%&~<>*/=+-]+",
])
_KIND = f"""case when regexp_full_match(str, '{_EMAIL}') then 'EMAIL' when regexp_full_match(str, '{_URI}') then 'URI'
  when regexp_full_match(str, '{_SYM}') then 'SYM' when regexp_full_match(str, '{_ABBR}') then 'ABBR' when regexp_full_match(str, '{_NUM}') then 'NUM'
  when regexp_matches(str, '{_L}') then 'LATIN' else 'UNK' end"""


def _tokens(table: str, keys: str, text: str = "text", first: str = "") -> str:
    """first: an alternative that comes before all others."""
    return f"""select {keys}, seq, str, {_KIND} type from (select {keys}, unnest(range(len(m))) seq, unnest(m) str
  from (select {keys}, regexp_extract_all({text}, '{first}{_RX}') m from {table}))"""


# Sentences. Texts are cut into pieces: what a period can stand in without ending a sentence, ends, paragraph breaks, and
# the rest. Each list of alternatives is ordered so that the first that matches is the longest at its place.
_ABBR_ALT = "|".join(sorted(ABBREVIATIONS.split(), key=len, reverse=True))
_UP, _LOW, _B = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]", r"[ \t\n]"
_TRAIL, _LEAD = r'[)\]}"]*', r'[(\[{"]*'
_STRONG = r"(?:\.(?:\.+|(?: \.){2,})|\?+|!+)"
_EOS = rf"(?:{_STRONG}|\.)"
_PARA = r"[ \t]*\n[ \t]*\n[ \t\n]*"
_ENDS = rf"(?:{_EOS}{_TRAIL})+"
_KEPT = rf"(?:{_L}+(?:\.{_L}+)+|{_ABBR_ALT}|[bcdfghjklmnpqrstvwxz]+)\.{_B}*"
_RULE_PIECE = "|".join([
    _EMAIL, rf"{_UP}\.{_B}{_UP}", rf"{_L}+\.{_TRAIL}[,;:]", rf"{_L}+(?:\.{_L}+)+\.{_B}*", rf"{_L}+(?:\.{_L}+)+", _KEPT,
    rf"(?:{_EOS}{_TRAIL})*{_EOS}{_TRAIL}{_B}*{_LEAD}{_LOW}", _ENDS, _PARA, rf"{_B}+", rf"{_A}+", "[0-9]+", "(?s:.)",
])
_BAYES_PIECE = "|".join([
    _EMAIL, rf"{_L}+(?:\.-?{_L}+)+", rf"{_STRONG}{_TRAIL}{_B}*{_LEAD}{_LOW}", rf"{_STRONG}{_TRAIL}", rf"\.{_TRAIL}", _PARA, rf"{_B}+", rf"{_L}+", "(?s:.)",
])
_PUT_BACK = "('ABBR', 'LATIN', 'SUFFIX', 'NUM')"

#: sent: the tokens of rule-based sentences, periods put back.
_SENT = rf"""with pc as (select doc_id, lang, unnest(range(len(m))) k, unnest(m) p, len(m) n from (select doc_id, lang, regexp_extract_all(text, '{_RULE_PIECE}') m from documents)),
ev as (select *, case when regexp_full_match(p, '{_ENDS}') then case when regexp_matches(p, '(^|[^.])\.{_TRAIL}$') then 'F' else 'E' end
  when regexp_full_match(p, '{_PARA}') then 'P' when k = n - 1 and regexp_full_match(p, '{_KEPT}') then 'F' end e from pc),
sl as (select doc_id, lang, s, string_agg(p, '' order by k) t, max(e) = 'F' final, min(b) b from
  (select *, coalesce(sum(case when e is null then 0 else 1 end) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) s,
    coalesce(sum(strlen(p)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) b from ev) group by doc_id, lang, s),
st as (select doc_id, lang, s, final, b, unnest(range(len(m))) i, unnest(m) str, unnest(gaps[:len(m)]) gap
  from (select doc_id, lang, s, final, b, regexp_extract_all(t, '{_RX}') m, regexp_split_to_array(t, '{_RX}') gaps from sl)),
ty as (select *, {_KIND} type, b + sum(strlen(gap) + strlen(str)) over w - strlen(str) o, final and i = max(case when str = '.' then i end) over (partition by doc_id, s) last
  from st window w as (partition by doc_id, s order by i)),
re as (select *, str = '.' and gap = '' and not coalesce(last, false) and coalesce(lag(type) over w in {_PUT_BACK}, false) back from ty window w as (partition by doc_id, s order by i)),
nx as (select *, coalesce(lead(back) over (partition by doc_id, s order by i), false) dot from re),
sent as (select doc_id, lang, (dense_rank() over (partition by doc_id order by s, (k // 1000)) - 1)::int sent_no, (k % 1000)::int tok_no,
  str || case when dot then '.' else '' end str, (strlen(str) + dot::int)::int len, o::bigint "offset", type
  from (select *, row_number() over (partition by doc_id, s order by i) - 1 k from nx where not back))"""

_TOK = f"with tok as ({_tokens('documents', 'doc_id, lang')})"
_CAND = f"""{_TOK},
ctx as (select doc_id, seq, str,
  lag(str, 2, '') over w l2, lag(type, 2, 'UNK') over w l2_type, lag(str, 1, '') over w l, lag(type, 1, 'UNK') over w l_type,
  lead(str, 1, '') over w r, lead(type, 1, 'UNK') over w r_type, lead(str, 2, '') over w r2, lead(type, 2, 'UNK') over w r2_type
  from tok window w as (partition by doc_id order by seq)),
cand as (select * exclude (str), case when r = '' or regexp_matches(r, '^\\p{{Lu}}') then 'EOS' else '!EOS' end as label from ctx where str = '.')"""


def _case(x: str) -> str:
    return rf"case when regexp_matches({x}, '^\p{{Lu}}') then 'LCAP' else 'LLOW' end"


def _feature(name: str) -> str:
    if "+" in name:
        return " || chr(1) || ".join(f"({_feature(n)})" for n in name.split("+"))
    s, kind = name.split("_")
    if kind.startswith("prefix"):
        return f"left({s}, {kind[6:]})"
    if kind.startswith("suffix"):
        return f"right({s}, {kind[6:]})"
    return {
        "word": s,
        "len": f"case when strlen({s}) < 2 then strlen({s})::varchar when strlen({s}) < 4 then '2..3' when strlen({s}) < 6 then '4..5' when strlen({s}) < 8 then '6..7' else '8..' end",
        "case": _case(s),
        "shape": f"case when {s}_type = 'LATIN' then {_case(s)} else {s}_type end",
        "mask": rf"translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, '[^\p{{L}}\p{{N}}]', chr(1), 'g'), '\p{{N}}', chr(2), 'g'), '[{_V}]', chr(3), 'g'), '\p{{L}}', 'C', 'g'), chr(1) || chr(2) || chr(3), 'PDV')",
    }[kind]


_NAMES = ("l_suffix4", "r_prefix4", "r_shape+l_mask", "l_case", "l_len", "r_mask")
_SIDES = [f"{s}_{k}" for s in "lr" for k in ("word", "len", "suffix2", "suffix3", "suffix4", "prefix2", "prefix3", "prefix4", "shape", "case", "mask")]
_VALUES = " union all ".join(f"select doc_id, seq, label, '{n}' feature, {_feature(n)} as value from cand" for n in _NAMES)
_FOLD = "(('0x' || md5(doc_id::varchar)[:8])::bigint % 5)"


def _model(rows: str, tag: str) -> str:
    """CTEs of a model that is trained on the rows that meet a condition."""
    return f"""
c{tag} as (select feature, value, count(*) filter (label = 'EOS') n_eos, count(*) filter (label = '!EOS') n_not from val where {rows} group by all),
n{tag} as (select count(*) filter (label = 'EOS') a_eos, count(*) filter (label = '!EOS') a_not, count(*) total, count(distinct label) k from cand where {rows}),
v{tag} as (select feature, count(*) v from c{tag} group by feature),
u{tag} as (select feature, log2(0.5::double / (a_eos + 0.5::double * v)) lp_eos, log2(0.5::double / (a_not + 0.5::double * v)) lp_not from v{tag}, n{tag}),
p{tag} as (select feature, value, log2((n_eos + 0.5::double) / (a_eos + 0.5::double * v)) lp_eos, log2((n_not + 0.5::double) / (a_not + 0.5::double * v)) lp_not
  from c{tag} join v{tag} using (feature), n{tag})"""


def _scores(rows: str, tag: str) -> str:
    return f"""(select doc_id, seq, any_value(label) as label, sum(coalesce(p{tag}.lp_eos, u{tag}.lp_eos)) + any_value(log2((a_eos + 0.5::double) / (total + 0.5::double * k))) lp_eos,
  sum(coalesce(p{tag}.lp_not, u{tag}.lp_not)) + any_value(log2((a_not + 0.5::double) / (total + 0.5::double * k))) lp_not,
  any_value(long) as long from val left join p{tag} using (feature, value) join u{tag} using (feature), n{tag} where {rows} group by doc_id, seq)"""


_VAL = f"{_CAND},\nval as (select x.*, long from ({_VALUES}) x join (select doc_id, seq, greatest(strlen(l), strlen(r)) > 128 as long from cand) using (doc_id, seq))"
_FOLDS = ",".join(_model(f"{_FOLD} <> {k}", str(k)) for k in range(5))
_JUDGED = " union all ".join(f"select * from {_scores(f'{_FOLD} = {k}', str(k))}" for k in range(5))
_ABBRS = ", ".join(f"('{w}')" for w in ABBREVIATIONS.split())

def _quoted(x) -> str:
    """A value as SQL; signs that aren't printable go by their numbers."""
    if not isinstance(x, str):
        return str(x).lower()
    parts, plain = [], ""
    for c in x:
        if c.isprintable() and ord(c) < 0x300:
            plain += c.replace("'", "''")
        else:
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
    return " || ".join(p for p in [*parts, f"'{plain}'"] if p != "''") or "''"


def _replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    return x


def _language_sql(rules: str, lang: str) -> str:
    """Tokens of derived texts: words are cut into listed words, prefixes before a letter, the rest and its suffix."""
    alt = lambda words: "|".join(w.replace("'", "''") for w in sorted(words.split(), key=len, reverse=True))
    prefix, suffix, words = (alt(t.get(rules, "")) for t in (lexicons.PREFIXES, lexicons.SUFFIXES, lexicons.WORDS))
    first = rf"''(?:[tT][iI][sS]|[tT][wW][aA][sS])|(?i:''til|&c)|" if rules == "en" else rf"(?i:ne''|e'')|" if rules == "it" else ""
    paths = r"(?:~|\.\.?)/\S+[A-Za-z0-9]/?|/(?:usr)(?:/\S+[A-Za-zÀ-ÖØ-öø-ÿ0-9])?/?|"
    numbers = r"(?:(?:19|20)[0-9]|[1-9])0''[sS]|0[xX][0-9a-fA-F]+|[0-9]+:[0-9]+|"
    cut = rf"(?i:{words})|(?i:{prefix})''[0-9].*|(?i:{prefix})''|.+"
    last = rf"^(.+?)((?i:{suffix}))$" if suffix else "^$()()"
    return rf"""select doc_id, string_agg(str || '/' || type, ' ' order by seq, k, j) t, count(*) filter (type = 'PREFIX') a, count(*) filter (type = 'SUFFIX') b, count(*) filter (type = 'URI') c, count(*) filter (type = 'PATH') d from (
  select doc_id, seq, k, unnest(strs) str, unnest(kinds) type, unnest(range(len(strs))) j from (
  select doc_id, seq, k, case when type <> 'LATIN' then [p] when {_is_word('p', words)} then [p] when regexp_full_match(p, '''[tT].*') then [p[:2], p[3:]] when regexp_full_match(p, '(?i:{prefix})''') then [p]
    when regexp_matches(p, '{last}') then [regexp_extract(p, '{last}', 1), regexp_extract(p, '{last}', 2)] else [p] end strs,
    case when type <> 'LATIN' then [type] when {_is_word('p', words)} then ['LATIN'] when regexp_full_match(p, '''[tT].*') then ['LATIN', 'LATIN'] when regexp_full_match(p, '(?i:{prefix})''') then ['PREFIX']
    when regexp_matches(p, '{last}') then ['LATIN', 'SUFFIX'] else ['LATIN'] end kinds
  from (select doc_id, seq, type, unnest(range(len(ps))) k, unnest(ps) p from (select doc_id, seq, type, case when type = 'LATIN' then regexp_extract_all(str, '{cut}') else [str] end ps from
    (select doc_id, seq, str, case when regexp_full_match(str, '{paths[:-1]}') then 'PATH' when regexp_full_match(str, '{numbers[:-1]}') then 'NUM' else type end type from
      ({_tokens(f"(select doc_id, {_replaced('text', cases.DERIVED[rules])} t from documents where lang = '{lang}')", "doc_id", "t", f"{_URI}|{paths}{numbers}{first}")}))))))
  group by doc_id"""


def _is_word(x: str, words: str) -> str:
    return f"regexp_full_match({x}, '(?i:{words})')" if words else "false"


_CATEGORY = " ".join(f"when regexp_matches(c, '\\p{{{k}}}') then '{chr(48 + i)}'" for i, k in enumerate(charsets.CATEGORIES) if k != "Cn")


def _unimask(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: case {_CATEGORY} else '0' end), '')"


# Signs of the classes as far as the tables, and the signs put into them, go.
_CLASSES = {
    "LETTER": r"\p{Latin}", "UPPER": r"[A-ZÀ-ÖØ-Þ]", "LOWER": "[a-zß-öø-ÿⅷ]", "LATIN": r"\p{Latin}|[0-9]", "NEWLINE": r"[\n\r]", "HORIZONTAL": r"[ \t]", "BLANK": r"\s", "NONBLANK": r"\S",
    "APOSTROPHE": "[''‘’]", "OPEN_SINGLE": "[''‘]", "CLOSE_SINGLE": "[''’]", "OPEN_DOUBLE": '["“„«‹]', "CLOSE_DOUBLE": '["”»›]', "OPEN_BRACKET": r"[(\[{]", "CLOSE_BRACKET": r"[)\]}]",
    "HYPHEN": "[-‐‑﹣]", "MINUS": "[-﹣−]", "DASH": "[‒–—]", "PERIOD": "[.．]", "ELLIPSIS": "…",
}


def _derived(sql: str) -> str:
    """The same SQL over documents with the texts for sentences."""
    own = f"derived as (select doc_id, lang, {_replaced('text', cases.DERIVED_SENTENCES)} as text from documents)"
    return f"with {own}, {sql.removeprefix('with ').replace('from documents', 'from derived').replace('join documents', 'join derived')}"


def _bayes_sql(judge: str = "") -> str:
    """Sentences by a classifier of (l_case, l_suffix3, r_shape), or by a condition over its columns: judged periods and other ends are positions, and a token's
    sentence is the number of ends up to it."""
    names = ("l_case", "l_suffix3", "r_shape")
    values = " union all ".join(f"select doc_id, seq, label, '{n}' feature, {_feature(n)} as value from cand" for n in names)
    model = _model("true", "a")
    return rf"""{_CAND.replace(_TOK, _TOK_AT)},
val as (select x.*, long from ({values}) x join (select doc_id, seq, greatest(strlen(l), strlen(r)) > 128 as long from cand) using (doc_id, seq)),{model},
judged as (select doc_id, seq, {judge or 'lp_eos >= lp_not or long'} or r = '' as ends from {_scores('true', 'a')} join cand using (doc_id, seq)),
pc as (select doc_id, unnest(range(len(m))) k, unnest(m) p from (select doc_id, regexp_extract_all(text, '{_BAYES_PIECE}') m from documents)),
pos as (select *, coalesce(sum(strlen(p)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) b from pc),
n_tok as (select doc_id, count(*) n, list(o order by o) os from tok group by doc_id),
prev as (select doc_id, seq + 1 seq, o + strlen(str) z from tok where type in {_PUT_BACK}),
own as (select pos.doc_id, b, b + strlen(p) z, ends, prev.z is not null and prev.z = b adj from pos join tok on tok.doc_id = pos.doc_id and o = b and str = '.'
  join judged on judged.doc_id = tok.doc_id and judged.seq = tok.seq left join prev on prev.doc_id = tok.doc_id and prev.seq = tok.seq where regexp_full_match(p, '\.{_TRAIL}')),
stop as (select doc_id, b, b + strlen(p) z, true ends, false adj, false judged from pos where regexp_full_match(p, '{_STRONG}{_TRAIL}')
  union all select doc_id, b, b, true, false, false from pos where regexp_full_match(p, '{_PARA}') union all select doc_id, b, z, ends, adj, true from own),
cnt as (select stop.*, (select count(*) from tok where tok.doc_id = stop.doc_id and o <= b) c, (select count(*) from tok where tok.doc_id = stop.doc_id and o < z) cz from stop),
evs as (select doc_id, list({{'c': c, 'z': cz, 'ends': ends, 'adj': adj, 'judged': judged, 'a': 0::bigint, 'd': 0::bigint, 'n': []::bigint[]}} order by b) e from cnt group by doc_id),
fold as (select doc_id, n, list_reduce(list_prepend({{'c': 0::bigint, 'z': 0::bigint, 'ends': false, 'adj': false, 'judged': false, 'a': 0::bigint, 'd': 0::bigint, 'n': []::bigint[]}}, coalesce(e, [])), lambda s, v:
  case when (v.judged and v.c - s.a - s.d >= 1000) or (v.ends and v.z - s.a - s.d >= 1000) then {{'c': v.c, 'z': v.z, 'ends': v.ends, 'adj': v.adj, 'judged': v.judged, 'a': s.a + 1000 + s.d, 'd': 0::bigint, 'n': list_append(s.n, 1000)}}
  when v.ends then {{'c': v.c, 'z': v.z, 'ends': v.ends, 'adj': v.adj, 'judged': v.judged, 'a': v.z, 'd': 0::bigint, 'n': list_append(s.n, v.z - s.a - s.d)}}
  when v.adj then {{'c': v.c, 'z': v.z, 'ends': v.ends, 'adj': v.adj, 'judged': v.judged, 'a': s.a, 'd': s.d + 1, 'n': s.n}} else s end) f from n_tok left join evs using (doc_id)),
outs as (select doc_id, list_concat(f.n, list_transform(range(0, (n - f.a - f.d + 999) // 1000), lambda i: least(1000, n - f.a - f.d - i * 1000))) ns from fold),
bayes as (select doc_id, unnest(range(len(ns))) sent_no, unnest(ns) n_tokens from (select doc_id, list_filter(ns, lambda x: x > 0) ns from outs)),
{_SENT.removeprefix("with ").replace("pc as", "rule_pc as", 1).replace("end e from pc)", "end e from rule_pc)")}
select doc_id, sent_no::int sent_no, n_tokens::int n_tokens from bayes join documents using (doc_id) where lang in ('de', 'en', 'fr', 'it')
union all select doc_id, sent_no, count(*)::int from sent where lang not in ('de', 'en', 'fr', 'it') group by doc_id, sent_no"""


def _search_sql() -> str:
    """Sets of one or two features by cross-validation: a model for each fold, scores of each feature, and all pairs of them."""
    values = " union all ".join(f"select doc_id, seq, label, {_FOLD} k, '{n}' feature, {_feature(n)} as value from cand" for n in SEARCHED)
    return f"""{_CAND}, val as ({values}), ks as (select unnest(range(5)) k),
c as (select ks.k, feature, value, count(*) filter (label = 'EOS') e, count(*) filter (label = '!EOS') n from val join ks on val.k <> ks.k group by all),
t as (select k, feature, sum(e) te, sum(n) tn, count(*) v from c group by all),
x as (select val.doc_id, val.seq, val.k, val.label, val.feature, log2((coalesce(e, 0) + 0.5::double) / (te + 0.5::double * v)) - log2((coalesce(n, 0) + 0.5::double) / (tn + 0.5::double * v)) o,
  log2((te + 0.5::double) / (tn + 0.5::double)) p from val join t using (k, feature) left join c using (k, feature, value)),
s as (select a.feature || coalesce(' ' || b.feature, '') features, a.label = 'EOS' t, round(a.p + a.o + coalesce(b.o, 0), 9) >= 0 or long s
  from x a join (select doc_id, seq, greatest(strlen(l), strlen(r)) > 128 as long from cand) using (doc_id, seq)
  join (select doc_id, seq, feature, o from x union all select doc_id, seq, null, null from cand) b on a.doc_id = b.doc_id and a.seq = b.seq and (b.feature is null or a.feature < b.feature)),
m as (select features, count(*) n, count(*) filter (t and s) tp, count(*) filter (not t and s) fp, count(*) filter (t and not s) fn from s group by features)
select *, round((n - fp - fn) * 100.0::double / n, 6) accuracy, round(200.0::double * tp / nullif(2 * tp + fp + fn, 0), 6) f1 from m"""


#: Features among which sets are searched.
SEARCHED = ("l_case", "l_len", "l_shape", "l_suffix2", "l_suffix3", "r_len", "r_mask", "r_prefix2", "r_shape")

#: Tokens with their byte offsets.
_TOK_AT = f"""with m as (select doc_id, lang, regexp_extract_all(text, '{_RX}') m, regexp_split_to_array(text, '{_RX}') p from documents),
t as (select doc_id, lang, unnest(range(len(m))) seq, unnest(m) str, unnest(p[:len(m)]) gap from m),
tok as (select doc_id, lang, seq, str, {_KIND} type, sum(strlen(gap) + strlen(str)) over (partition by doc_id order by seq) - strlen(str) o from t)"""

ORACLES = {
    "sentences_fsm": f'{_SENT} select doc_id, sent_no, tok_no, str, len, "offset", type from sent',
    "sentence_len_hist": f"{_SENT}, n as (select doc_id, lang, sent_no, count(*) n from sent group by all) select lang, n::int n_tokens, count(*) n from n group by lang, n.n",
    "format_sentences": f"""{_SENT}, f as (select doc_id, sent_no, string_agg(regexp_replace(str, '[ \t\n]+', ' ', 'g') || ' ', '' order by tok_no) t from sent group by doc_id, sent_no)
select doc_id, string_agg(t || '|' || chr(10), '' order by sent_no) lines from f group by doc_id""",
    "sentences_bayes": _bayes_sql(),
    "sentences_by_model_file": _bayes_sql(),
    "token_type_hist": f"{_TOK} select lang, type, count(*) n from tok group by all",
    "token_stream": f"""with m as (select doc_id, regexp_extract_all(text, '{_RX}') m, regexp_split_to_array(text, '{_RX}') p from documents),
t as (select doc_id, unnest(range(len(m))) seq, unnest(m) str, unnest(p[:len(m)]) gap from m)
select doc_id, seq::int seq, str, strlen(str)::int len, (sum(strlen(gap) + strlen(str)) over (partition by doc_id order by seq) - strlen(str))::bigint "offset", {_KIND} type from t""",
    "token_stream_sql": f"{_TOK} select lang, type, count(*) n, sum(strlen(str))::bigint bytes from tok group by all",
    "conversation_tokens": f"with tok as ({_tokens('conversations', 'role')}) select role, type, count(*) n, count(distinct str) distinct_tokens from tok group by all",
    "page_tokens": f"with tok as ({_tokens('pages', 'page_id', 'html', '&[cC]|')}) select page_id, type, count(*) n, sum(strlen(str))::bigint bytes from tok group by all",
    "part_names": f"with tok as ({_tokens('part', 'p_partkey', 'p_name')}) select str, type, count(*) n, count(distinct p_partkey) parts from tok group by all",
    "grapheme_counts": "select doc_id, length_grapheme(text) n_graphemes from documents",
    "grapheme_stream": """with g as (select item_id, unnest(range(length(text))) seq, text from benchmark)
select item_id, seq::int seq, substr(text, seq + 1, 1) str, strlen(substr(text, seq + 1, 1))::int len, strlen(substr(text, 1, seq)) "offset" from g""",
    "byte_lengths": """select doc_id, strlen(text) n_bytes, length(text) n_points, strlen(left(text, 10)) offset_10,
  strlen(left(text, greatest(length(text) - 5, 0))) offset_last_5 from documents""",
    "text_classes": r"""select doc_id, regexp_matches(text, '^\p{L}') is_letter, regexp_matches(text, '^\p{Lu}') is_upper, regexp_matches(text, '^\p{Ll}') is_lower,
  regexp_matches(text, '^\p{N}') is_number, regexp_matches(text, '^[\p{Z}\t\n\r]') is_space, md5(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) squeezed_md5 from documents""",
    "normal_forms": "select doc_id, md5(nfc_normalize(text)) nfc_md5, md5(strip_accents(text)) plain_md5, md5(text) stripped_md5 from documents",
    "case_folds": "select doc_id, md5(replace(lower(text), 'ß', 'ss')) folded_md5 from documents",
    "nfc_paragraphs": r"""with p as (select doc_id, list_filter(regexp_split_to_array(text, '(?:[ \t]*\n){2,}'), lambda x: x <> '') p from documents),
q as (select doc_id, unnest(range(len(p))) para_no, regexp_replace(unnest(p), '\n$', '') || chr(10) t from p)
select doc_id, para_no::int para_no, length(nfc_normalize(t))::int n_chars, md5(nfc_normalize(t)) para_md5 from q""",
    "sentence_token_conservation": f"{_TOK} select doc_id, md5(string_agg(str, '' order by seq)) tokens_md5, md5(string_agg(str, '' order by seq)) sentences_md5 from tok group by doc_id",
    "format_tokens": f"{_TOK} select doc_id, md5(string_agg(str || chr(9) || type || chr(9) || strlen(str) || '%' || chr(10), '' order by seq)) text_md5 from tok group by doc_id",
    "sbd_candidates": f"{_CAND} select doc_id, seq::int seq, l2, l2_type, l, l_type, r, r_type, r2, r2_type, label from cand",
    "sbd_features": f"{_CAND} select doc_id, seq::int seq, label, {', '.join(f'{_feature(n)} as {n}' for n in _SIDES)} from cand",
    "nb_train_counts": f"{_CAND}, val as ({_VALUES}) select feature, value, count(*) filter (label = 'EOS') n_eos, count(*) filter (label = '!EOS') n_not from val group by all",
    "nb_train_model": f"""{_VAL},{_model('true', 'a')}
select 'value' part, feature, value, round(lp_eos, 9) lp_eos, round(lp_not, 9) lp_not from pa union all select 'unknown', feature, '', round(lp_eos, 9), round(lp_not, 9) from ua
union all select 'prior', '', '', round(log2((a_eos + 0.5::double) / (total + 0.5::double * k)), 9), round(log2((a_not + 0.5::double) / (total + 0.5::double * k)), 9) from na""",
    "nb_score": f"""{_VAL},{_model(f'{_FOLD} <> 0', '0')}
select doc_id, seq::int seq, round(lp_eos, 6) lp_eos, round(lp_not, 6) lp_not, lp_eos >= lp_not or long is_eos from {_scores(f'{_FOLD} = 0', '0')}""",
    "nb_eval": f"""{_VAL},{_FOLDS},
j as (select label = 'EOS' t, lp_eos >= lp_not or long s from ({_JUDGED})),
s as (select 'bayes' as method, count(*) n, count(*) filter (t and s) tp, count(*) filter (not t and s) fp, count(*) filter (t and not s) fn from j
  union all select 'always', count(*), count(*) filter (t), count(*) filter (not t), 0 from j),
r as (select *, tp * 100.0::double / (tp + fp) p, tp * 100.0::double / (tp + fn) r from s)
select method, round((n - fp - fn) * 100.0::double / n, 6) accuracy, round(p, 6) as precision, round(r, 6) recall, round(2 * p * r / (p + r), 6) f1 from r""",
    "type_rollup_by_lang": f"{_TOK} select lang, type, count(*) n from tok group by rollup (lang, type)",
    "top_tokens": f"""{_TOK}, n as (select lang, str, count(*) n from tok where type = 'LATIN' group by all)
select * from (select lang, str, n, (row_number() over (partition by lang order by n desc, str))::int rank from n) where rank <= 10""",
    "vocab_except": f"{_TOK}, items as ({_tokens('benchmark', 'item_id')}) select distinct str from tok where type = 'LATIN' and str not in (select str from items where type = 'LATIN')",
    "vocab_intersect": f"{_TOK}, items as ({_tokens('benchmark', 'item_id')}) select str from tok where type = 'LATIN' intersect select str from items where type = 'LATIN'",
    "abbreviation_hits": f"{_CAND} select lang, l, count(*) n from cand join documents using (doc_id) where l in (select * from (values {_ABBRS})) group by all",
    "languages": "select lang, lang in ('de', 'en', 'fr', 'it') own, count(*) n from documents group by all",
    "type_names": f"""{_TOK}, k as (select type, list_position(['UNK', 'LATIN', 'PREFIX', 'SUFFIX', 'SYM', 'NUM', 'ABBR', 'EMAIL', 'URI', 'PATH'], type) - 1 code, count(*) n from tok group by type)
select code::int code, type as name, 'UNK' beyond, n from k""",
    "token_micro_batches": f"{_TOK} select doc_id, seq::int seq, str, type from tok",
    "language_rules": "select doc_id, md5(t) tokens_md5, a::int n_prefix, b::int n_suffix, c::int n_uri, d::int n_path from (" + " union all ".join(_language_sql(*x) for x in (("en", "en"), ("fr", "fr"), ("it", "es"))) + ")",
    "sentence_rules": _derived(f'{_SENT} select doc_id, sent_no, tok_no, str, len, "offset", type from sent'),
    "sentence_rules_bayes": _derived(_bayes_sql(r"regexp_matches(r, '^\p{Lu}')")),
    "grapheme_rules": rf"""select doc_id, len(g)::int n, md5(array_to_string(g, '|')) clusters_md5 from (select doc_id, regexp_extract_all({_replaced('text', cases.DERIVED_CLUSTERS)},
  '\r\n|(?:\x{{1100}}\x{{1161}}|[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|\x{{1F466}}\x{{1F3FD}}|(?s:.))[\x{{300}}-\x{{36f}}\x{{e33}}]*') g from documents)""",
    "character_classes": f"""with t as (select text from documents union all select html from pages union all select translate(text, {_quoted(cases.DERIVED_SIGNS[0])}, {_quoted(cases.DERIVED_SIGNS[1])}) from documents),
s as (select c, count(*) n from (select unnest(string_split(text, '')) c from t) where c <> '' group by c)
select x.name as class, sum(n)::bigint n, count(*) signs from s join (values {', '.join(f"('{n}', '{p}')" for n, p in _CLASSES.items())}) x(name, rx) on regexp_full_match(c, rx) group by x.name""",
    "property_counts": f"""with t as (select text from documents union all select html from pages union all select {_replaced('text', cases.DERIVED_CLUSTERS)} from documents),
s as (select c, unicode(c) u, count(*) n from (select unnest(string_split(text, '')) c from t) where c <> '' group by c)
select p.name property, sum(n)::bigint n, count(*) signs from s join (values {', '.join(map(str, properties.property_ranges()))}) p(name, a, z) on u between a and z group by p.name""",
    "feature_rules": f"""{_CAND}, f as (select *, {_unimask('l')} lm, {_unimask('r')} rm from cand)
select doc_id, seq::int seq, {_case('l')} || '|' || right(l, 3) || '|' || {_feature('r_shape')} de, right(l, 4) || '|' || left(r, 4) || '|' || {_feature('r_shape')} || '/' || {_feature('l_mask')} en,
  lm fr, {_case('l')} || '|' || right(l, 2) || '|' || left(r, 4) || '/' || rm it, lm l_unimask, rm r_unimask from f""",
    "corpus_tokens": f"""{_SENT}, m as (select *, str in ('.', '?', '!') mark from sent),
e as (select doc_id, sent_no, max(tok_no) filter (mark) e, coalesce(max(tok_no) filter (type <> 'SYM' and not mark), -1) w, max(tok_no) z from m group by doc_id, sent_no)
select type, tok_no = case when e > w then e else z end is_end, count(*) n, count(distinct regexp_replace(str, ' +', ' ', 'g')) distinct_tokens from m join e using (doc_id, sent_no) group by all""",
    "corpus_contexts": f"""{_SENT}, m as (select *, str in ('.', '?', '!') mark, lag(type) over (partition by doc_id, sent_no order by tok_no) l_type from sent),
e as (select doc_id, sent_no, max(tok_no) filter (mark) e, coalesce(max(tok_no) filter (type <> 'SYM' and not mark), -1) w, max(tok_no) z from m group by doc_id, sent_no having count(*) > 1)
select l_type, case when tok_no = case when e > w then e else z end then 'EOS' else '!EOS' end as label, count(*) n from m join e using (doc_id, sent_no) where str = '.' and tok_no > 0 group by all""",
    "text_lines": "select md5(l) line_md5, count(*) n from (select unnest(string_split(text, chr(10))) l from documents) group by 1",
    "text_paragraphs": r"""with p as (select list_filter(regexp_split_to_array(text, '(?:[ \t]*\n){2,}'), lambda x: not regexp_full_match(x, '\s*')) p from documents)
select md5(regexp_replace(x, '\n$', '') || chr(10)) para_md5, count(*) n from (select unnest(p) x from p) group by 1""",
    "text_rules": f"""with t as (select doc_id, {_replaced('text', cases.DERIVED_FORMS)} t, text from documents)
select doc_id, md5(replace(t, chr(173), '')) visible_md5, md5(replace(t, chr(888), '')) assigned_md5, md5(replace(t, chr(64257), 'fi')) nfkc_md5,
  md5(replace(replace(lower(t), 'ß', 'ss'), chr(64257), 'fi')) folded_md5, md5(replace(t, chr(173), '')) prepared_md5, md5(replace(text, 'f', 'fi')) cleaned_md5 from t""",
    "conversation_sentences": _SENT.replace("with pc as", "with convs as (select conv_id doc_id, 'en' lang, string_agg(coalesce(text, ''), chr(10) order by turn) as text from conversations group by conv_id),\npc as", 1).replace("from documents", "from convs")
    + """ select doc_id conv_id, sent_no::bigint sent_no, min("offset") as "offset", count(*) n_tokens, md5(string_agg(str, ' ' order by tok_no)) sentence_md5 from sent group by doc_id, sent_no""",
    "nb_counts_stream": f"{_CAND}, val as ({_VALUES}) select feature, value, (count(*) filter (label = 'EOS'))::bigint n_eos, (count(*) filter (label = '!EOS'))::bigint n_not from val group by all",
    "formatted_files": f"{_TOK} select type || chr(9) || strlen(str) || chr(9) || regexp_replace(str, '[ \\t\\n]+', ' ', 'g') line, count(*) n from tok group by 1",
    "feature_export": f"""{_CAND} select label, {_case('l')} l_case, {_feature('r_shape')} r_shape, count(*) n, count(*) filter (r = '') boundaries,
  count(distinct case when l = '' then '***BOUNDARY***' else l end) words, count(distinct nullif({_feature('r_mask')}, '')) masks from cand group by all""",
    "token_graphemes": f"{_TOK} select type, count(*) tokens, sum(length_grapheme(str))::bigint clusters, sum(strlen(str))::bigint bytes from tok group by type",
    "feature_search": _search_sql(),
    "model_file": f"{_VAL},{_model('true', 'a')} select feature, value, round(lp_eos, 9) lp_eos, round(lp_not, 9) lp_not from pa where feature in ('l_case', 'l_len')",
    "cleaned_tokens": f"{_TOK} select type, count(*) n, sum(strlen(str))::bigint bytes from tok group by type",
    "type_counts_stream": """with e as (select time_bucket(interval '1 hour', ts) as hour, regexp_extract_all(event_type, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]') m, ts from events),
t as (select hour, unnest(m) str from e)
select strftime(hour, '%Y-%m-%d %H') as hour, case when regexp_matches(str, '[A-Za-z]') then 'LATIN' else 'UNK' end type, count(*) n from t
where t.hour + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events) group by all""",
}
