"""Sentences by a classifier of any size, in set form: periods are rows that are joined with the model's tables.

What can end a sentence depends on the text alone, so it is found in the narrow stage that finds the tokens. The periods
among it are scored by ``sbd.score``, where the model is three tables and need not fit into a task. Ends and tokens are
then rows on one line for each document, ordered by byte offset, and a running count of the ends numbers the sentences.
``segment.sentences`` gives the same for models that a task can hold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charsets as cs
from ..functions.batches import arrow_slices
from ..sources.scratch import written
from . import sbd
from . import segment as sg
from .sentences import MAX_TOKENS, bayes_events, bayes_sentences
from .tokens import BOM, LANGUAGES

_EVENT = pa.struct([("judge", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
_EVENTS = T.ArrayType(T.StructType([T.StructField("judge", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TOKEN = ["str", "len", "offset", "type"]


def events_of(text: str) -> list[tuple[bool, int, int]]:
    """(whether it is a period to be judged, start, end) in bytes, of what can end a sentence."""
    start = 1 if text.startswith(BOM) else 0
    body, out, at, offset = text[start:], [], 0, 3 * start
    for kind, a, z in bayes_events(body):
        offset += len(body[at:a].encode())
        size = len(body[a:z].encode())
        out.append((kind == "period", offset, offset + size))
        at, offset = z, offset + size
    return out


@arrow_slices(_EVENTS)
def sentence_events(text: pa.Array) -> pa.Array:
    def structs(rows):
        cols = zip(*rows, strict=True) if rows else [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _EVENT, strict=True)], fields=list(_EVENT))

    return sg._lists([None if t is None else events_of(t) for t in text.to_pylist()], structs)


@arrow_slices(T.ArrayType(sg.TOKENS))
def _with_decisions(text: pa.Array, lang: pa.Array, decided: pa.Array) -> pa.Array:
    """The in-row splitter with periods that are judged already, told by the offset of the token after them."""
    found = []
    for t, g, d in zip(text.to_pylist(), lang.to_pylist(), decided.to_pylist(), strict=True):
        ends = {x["r_offset"]: x["ends"] for x in d or ()}
        found.append(bayes_sentences(t, g, lambda _, right, ends=ends: ends[right[2]]))
    return sg._lists(found, lambda x: sg._lists(x, sg._structs))


def sentence_tokens(docs: DataFrame, keys: list[str], lang: Column | str, features: tuple[str, ...], model: sbd.Tables, text: str = "text") -> DataFrame:
    """One row per token of each sentence: keys, sent_no, tok_no, str, len, offset, type.

    ``keys`` tell documents apart and must not be missing. Languages without a classifier (none of de, en, fr, it) are
    split by rules. A missing or empty text has no sentences. Documents in which a sentence reaches the limit of
    ``MAX_TOKENS`` are split row by row, by the same decisions. Other columns are not read.
    """
    docs = docs.select(*keys, sg._language(lang).alias("_lang"), F.col(text).cast("string").alias("_text"))
    own = F.col("_lang").isin(*LANGUAGES)
    plain = sg.sentence_token_table(docs.where(~F.coalesce(own, F.lit(False))), F.col("_lang"), "_text", sbd="fsm").drop("_lang")
    docs = docs.where(own)
    parts = written(docs.select(*keys, sg.tokens("_text", F.col("_lang")).alias("tokens"), sentence_events("_text").alias("events")), "segmented")

    # Periods with their neighbours, cleaned, and judged by joins with the model.
    found = parts.select(*keys, F.explode(sbd.contexts_in(F.col("tokens"), cs.PERIODS, offsets=True)).alias("c")).select(*keys, "c.*")
    found = found.withColumn("last", F.col("r") == "").withColumns({c: sbd.cleaned(c) for c in ("l", "r")})
    scored = sbd.score(found, [*keys, "seq", "offset", "r_offset", "last"], features, model)
    judged = written(scored.select(*keys, "offset", "r_offset", (F.col("is_eos") | F.col("last")).alias("ends")), "judged")

    # One line of rows for each document: ends (0), periods that end nothing (1) and tokens (2).
    events = parts.select(*keys, F.explode("events").alias("e")).select(*keys, "e.*")
    periods = events.where("judge").join(judged.withColumnRenamed("offset", "start"), [*keys, "start"])
    row = lambda df, at, kind: df.select(*keys, F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(None).cast(sg.TOKEN).alias("t"))
    tokens = parts.select(*keys, F.explode("tokens").alias("t")).select(*keys, F.col("t.offset").alias("at"), F.lit(2).alias("kind"), "t")
    line = tokens.unionByName(row(events.where("not judge"), "end", 0)).unionByName(row(periods.where("ends"), "end", 0)).unionByName(row(periods.where("not ends"), "start", 1))
    whole = Window.partitionBy(*keys).orderBy("at", "kind")
    line = line.withColumns({"sent": F.sum((F.col("kind") == 0).cast("long")).over(whole), "loose": F.lag("kind").over(whole) == 1}).where("kind = 2")
    # A period that ends nothing goes back onto an abbreviation, word or number right before it.
    before = F.lag("t").over(whole)
    back = F.coalesce("loose", F.lit(False)) & (before["offset"] + before["len"] == F.col("t.offset")) & before["type"].isin("ABBR", "LATIN", "SUFFIX", "NUM")
    line = line.withColumn("back", F.coalesce(back, F.lit(False)))
    after = F.lead(F.when(F.col("back"), F.col("t"))).over(whole)
    line = line.withColumns({"dot": after["str"], "dot_len": after["len"], "size": F.count("*").over(Window.partitionBy(*keys, "sent"))})
    line = line.withColumn("long", F.max("size").over(Window.partitionBy(*keys)) >= MAX_TOKENS)
    line = written(line.select(*keys, "sent", "at", "kind", "t", "back", "dot", "dot_len", "long"), "numbered")

    short = line.where("not long and not back")
    sent = F.dense_rank().over(Window.partitionBy(*keys).orderBy("sent")) - 1
    order = F.row_number().over(Window.partitionBy(*keys, "sent").orderBy("at")) - 1
    token = {"str": F.concat(F.col("t.str"), F.coalesce("dot", F.lit(""))), "len": F.col("t.len") + F.coalesce("dot_len", F.lit(0)), "offset": F.col("t.offset"), "type": F.col("t.type")}
    short = short.select(*keys, sent.alias("sent_no"), order.alias("tok_no"), *[c.alias(n) for n, c in token.items()])
    decided = judged.groupBy(*keys).agg(F.collect_list(F.struct("r_offset", "ends")).alias("decided"))
    rest = docs.join(line.where("long").select(*keys).distinct(), keys, "left_semi").join(decided, keys, "left")
    rest = rest.select(*keys, F.posexplode(_with_decisions("_text", "_lang", "decided")).alias("sent_no", "tokens"))
    rest = rest.select(*keys, "sent_no", F.posexplode("tokens").alias("tok_no", "t")).select(*keys, "sent_no", "tok_no", *[F.col(f"t.{c}").alias(c) for c in _TOKEN])
    return short.unionByName(rest).unionByName(plain.select(*keys, "sent_no", "tok_no", *_TOKEN))
