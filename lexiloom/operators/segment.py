"""Segmentation as DataFrame columns and tables.

Each function is deterministic and keeps no state between rows, so it works alike on batch and streaming inputs, and
filters on other columns are pushed below it. A missing text gives a missing result, an empty text an empty array.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import arrow_slices
from . import graphemes as _g
from . import sentences as _s
from . import tokens as _t

TOKEN = T.StructType([T.StructField("str", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("type", T.StringType())])
TOKENS = T.ArrayType(TOKEN)
_TOKEN = pa.struct([("str", pa.string()), ("len", pa.int32()), ("offset", pa.int64()), ("type", pa.string())])


def _structs(rows: list[tuple]) -> pa.Array:
    cols = zip(*rows, strict=True) if rows else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _TOKEN, strict=True)], fields=list(_TOKEN))


def _lists(found: list[list | None], inner) -> pa.Array:
    """Nested lists as one Arrow array; None stays missing."""
    offsets, flat, at = [], [], 0
    for x in found:
        offsets.append(None if x is None else at)
        flat += x or []
        at += len(x or [])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), inner(flat))


@arrow_slices(TOKENS)
def _tokens(text: pa.Array, lang: pa.Array) -> pa.Array:
    return _lists([None if t is None else _t.tokenize(t, g) for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True)], _structs)


@arrow_slices(T.ArrayType(T.StringType()))
def _types(text: pa.Array, lang: pa.Array) -> pa.Array:
    found = [None if t is None else [k for _, _, k in _with_suffixes(t, g)] for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True)]
    return _lists(found, lambda x: pa.array(x, pa.string()))


def _with_suffixes(text: str, lang: str | None):
    return _t.scanner(lang).scan(text.removeprefix(_t.BOM))


@arrow_slices(TOKENS)
def _graphemes(text: pa.Array) -> pa.Array:
    return _lists([None if t is None else _g.graphemes(t) for t in text.to_pylist()], _structs)


@arrow_slices(T.ArrayType(T.StringType()))
def _strings(text: pa.Array, lang: pa.Array, kind: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), lang.to_pylist(), kind.to_pylist(), strict=True)
    found = [None if t is None else [s for s, k in _t.typed(t, g) if k == own] for t, g, own in rows]
    return _lists(found, lambda x: pa.array(x, pa.string()))


_NEIGHBOURS = ("l2", "l", "r", "r2")
_CONTEXT = pa.struct([("seq", pa.int32()), *[(c, pa.string()) for n in _NEIGHBOURS for c in (n, f"{n}_type")]])
_CONTEXTS = T.ArrayType(T.StructType([T.StructField("seq", T.IntegerType()), *[T.StructField(c, T.StringType()) for n in _NEIGHBOURS for c in (n, f"{n}_type")]]))


def _contexts_of(text: str, lang: str | None) -> list[tuple]:
    """Stretches of plain words have no periods, so only the tokens at their ends are told and the others counted."""
    none = ("", "UNK")
    body, tokens, skipped, periods = text.removeprefix(_t.BOM), [none, none], 0, []
    for a, z, kind in _t.scanner(lang).scan(body, stretches=True):
        found = body[a:z]
        if kind:
            if found == ".":
                periods.append((len(tokens), len(tokens) - 2 + skipped))
            tokens.append((found, kind))
            continue
        parts = _t.parts(found)
        if len(parts) > 4:
            skipped += len(parts) - 4
            parts = parts[:2] + parts[-2:]
        tokens += _t.parts_typed(parts)
    tokens += none, none
    return [(seq, *tokens[i - 2], *tokens[i - 1], *tokens[i + 1], *tokens[i + 2]) for i, seq in periods]


@arrow_slices(_CONTEXTS)
def _period_contexts(text: pa.Array, lang: pa.Array) -> pa.Array:
    def structs(rows):
        cols = zip(*rows, strict=True) if rows else [()] * len(_CONTEXT)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CONTEXT, strict=True)], fields=list(_CONTEXT))

    return _lists([None if t is None else _contexts_of(t, g) for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True)], structs)


@arrow_slices(T.LongType())
def _grapheme_count(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _g.count(t) for t in text.to_pylist()], pa.int64())


@arrow_slices(T.ArrayType(T.IntegerType()))
def _rule_sentence_sizes(text: pa.Array, lang: pa.Array) -> pa.Array:
    found = [None if t is None else [len(s) for s in _s.rule_sentences(t, g)] for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True)]
    return _lists(found, lambda x: pa.array(x, pa.int32()))


@arrow_slices(T.ArrayType(TOKENS))
def _rule_sentences(text: pa.Array, lang: pa.Array) -> pa.Array:
    found = [None if t is None else _s.rule_sentences(t, g) for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True)]
    return _lists(found, lambda x: _lists(x, _structs))


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _language(lang: Column | str | None) -> Column:
    """A column, or a language's name as a constant."""
    return lang if isinstance(lang, Column) else F.lit(lang).cast("string")


def graphemes(text: Column | str) -> Column:
    """Array of grapheme clusters as token structs; the type is always UNK."""
    return _graphemes(_column(text).cast("string"))


def tokens(text: Column | str, lang: Column | str | None = "en") -> Column:
    """Array of typed tokens. Languages other than en, fr and it are tokenised by the generic rules."""
    return _tokens(_column(text).cast("string"), _language(lang))


def token_types(text: Column | str, lang: Column | str | None = "en") -> Column:
    """Only the tokens' types: a narrow form for counting."""
    return _types(_column(text).cast("string"), _language(lang))


def token_strings(text: Column | str, lang: Column | str | None, kind: str) -> Column:
    """Only the texts of the tokens of one type, in order: a narrow form for vocabularies."""
    return _strings(_column(text).cast("string"), _language(lang), F.lit(kind))


def period_contexts(text: Column | str, lang: Column | str | None = "en") -> Column:
    """Only the periods with two tokens on either side: what ``sbd.contexts_in`` gives for the tokens, without handing them over."""
    return _period_contexts(_column(text).cast("string"), _language(lang))


def grapheme_count(text: Column | str) -> Column:
    """Only the number of grapheme clusters."""
    return _grapheme_count(_column(text).cast("string"))


def sentence_sizes(text: Column | str, lang: Column | str | None = "en") -> Column:
    """Only the numbers of tokens of the rule-based sentences: a narrow form for counting."""
    return _rule_sentence_sizes(_column(text).cast("string"), _language(lang))


def sentences(text: Column | str, lang: Column | str | None = "en", sbd: str = "bayes", model=None) -> Column:
    """Array of sentences, each an array of tokens.

    sbd ``fsm`` uses rules alone; ``bayes`` asks ``model``, a classifier of periods (see ``sbd.Model``), or a dict of
    them by language; languages without one are split by rules if they are none of de, en, fr and it, and otherwise
    are an error.
    """
    if sbd == "fsm":
        return _rule_sentences(_column(text).cast("string"), _language(lang))
    if sbd != "bayes":
        raise ValueError(f"sbd is 'bayes' or 'fsm', not {sbd!r}")
    models = model if isinstance(model, dict) else {g: model for g in _t.LANGUAGES} if model else {}
    if not models:
        raise ValueError("cannot open model: sbd='bayes' needs a model")

    @arrow_slices(T.ArrayType(TOKENS))
    def split(text: pa.Array, lang: pa.Array) -> pa.Array:
        found: list = []
        for t, g in zip(text.to_pylist(), lang.to_pylist(), strict=True):
            if t is None:
                found.append(None)
            elif g in models:
                found.append(_s.bayes_sentences(t, g, models[g].at_end))
            elif g in _t.LANGUAGES:
                raise ValueError(f"cannot open model: none is given for {g!r}")
            else:
                found.append(_s.rule_sentences(t, g))
        return _lists(found, lambda x: _lists(x, _structs))

    return split(_column(text).cast("string"), _language(lang))


def parse_config(config: str) -> tuple[str, str]:
    """('fr', 'bayes') from 'fr bayes', 'fr' or the like; a language name that isn't two letters long is no language."""
    lang, _, sbd = config.partition(" ")
    return (lang if len(lang) == 2 else "zz"), (sbd or "bayes") if " " not in config or sbd == "bayes" else "fsm"


def segment(df: DataFrame, mode: str, config: str = "en", text: str = "text", model=None) -> DataFrame:
    """``df`` with one more row dimension: its tokens, graphemes or sentences, by mode and a language config string."""
    lang, sbd = parse_config(config)
    if mode == "grapheme":
        return grapheme_table(df, text)
    if mode == "token":
        return token_table(df, lang, text)
    if mode == "sentence":
        return sentence_table(df, lang, text, sbd if lang in _t.LANGUAGES else "fsm", model)
    raise ValueError(f"mode is 'grapheme', 'token' or 'sentence', not {mode!r}")


def _exploded(df: DataFrame, array: Column, text: str, names: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in {text, *names, "_at", "_token"}]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(array).alias("_at", "_token"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("_at").alias(names[0]), *[F.col(f"_token.{c}").alias(c) for c in names[1:]])


def grapheme_table(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per grapheme cluster: seq, str, len, offset and the other columns of ``df``; columns of these names are replaced, here and in the other tables."""
    return _exploded(df, graphemes(text), text, ["seq", "str", "len", "offset"])


def token_table(df: DataFrame, lang: Column | str | None = "en", text: str = "text") -> DataFrame:
    """One row per token: seq, str, len, offset, type and the other columns of ``df``."""
    return _exploded(df, tokens(text, lang), text, ["seq", "str", "len", "offset", "type"])


def sentence_table(df: DataFrame, lang: Column | str | None = "en", text: str = "text", sbd: str = "bayes", model=None) -> DataFrame:
    """One row per sentence: sent_no, tokens and the other columns of ``df``."""
    keep = [c for c in df.columns if c not in (text, "sent_no", "tokens")]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(sentences(text, lang, sbd, model)).alias("sent_no", "tokens"))


def sentence_token_table(df: DataFrame, lang: Column | str | None = "en", text: str = "text", sbd: str = "bayes", model=None) -> DataFrame:
    """One row per token of each sentence: sent_no, tok_no, str, len, offset, type and the other columns of ``df``."""
    rows = sentence_table(df, lang, text, sbd, model)
    return _exploded(rows, F.col("tokens"), "tokens", ["tok_no", "str", "len", "offset", "type"])


def languages(spark: SparkSession) -> DataFrame:
    """The languages with rules or models of their own, in order."""
    return spark.createDataFrame([(g,) for g in _t.LANGUAGES], "lang string")


def type_name(code: Column) -> Column:
    """The name of a token type's number; UNK for any number that is none."""
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in _t.TYPES]), code), F.lit("UNK"))


@F.udtf(returnType=T.StructType([T.StructField("seq", T.IntegerType()), *TOKEN.fields]))
class TokenizeUDTF:
    """SQL: SELECT ... FROM documents, LATERAL tokenize(text, lang)."""

    def eval(self, text: str, lang: str):
        if text is not None:
            for seq, token in enumerate(_t.tokenize(text, lang)):
                yield seq, *token


@F.arrow_udtf(returnType=T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("seq", T.IntegerType()), *TOKEN.fields]))
class TokenizeTable:
    """SQL: SELECT ... FROM tokenize_table(TABLE(SELECT doc_id, lang, text FROM documents)), in batches of rows.

    Its argument has the columns doc_id, lang and text. A missing text has no tokens.
    """

    def eval(self, rows: pa.RecordBatch):
        ids, langs = rows.column("doc_id").cast(pa.int64()), rows.column("lang").cast(pa.string())
        found = [[] if t is None else _t.tokenize(t, g) for t, g in zip(rows.column("text").to_pylist(), langs.to_pylist(), strict=True)]
        owner = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
        tokens = _structs([t for x in found for t in x])
        seq = pa.array([k for x in found for k in range(len(x))], pa.int32())
        yield pa.RecordBatch.from_arrays([ids.take(owner), langs.take(owner), seq, *tokens.flatten()], ["doc_id", "lang", "seq", *[f.name for f in _TOKEN]])


def register(spark: SparkSession) -> None:
    """Make tokens, graphemes, sentences (by rules) and the table functions tokenize and tokenize_table known to SQL."""
    spark.udf.register("tokens", _tokens)
    spark.udf.register("graphemes", _graphemes)
    spark.udf.register("sentences", _rule_sentences)
    spark.udtf.register("tokenize", TokenizeUDTF)
    spark.udtf.register("tokenize_table", TokenizeTable)
