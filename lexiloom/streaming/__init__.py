"""Segmentation of streams: narrow functions in append mode, and what needs a state or tables over several batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sbd
from ..operators import segment as sg
from ..operators.sentences import rule_sentences


def token_stream(docs: DataFrame, lang: Column | str | None = "en") -> DataFrame:
    """Tokens of a stream of documents."""
    return sg.token_table(docs, lang)


def sentence_stream(docs: DataFrame, lang: Column | str | None = "en", sbd: str = "fsm", model=None) -> DataFrame:
    """Sentences of a stream of documents."""
    return sg.sentence_table(docs, lang, sbd=sbd, model=model)


def type_counts(docs: DataFrame, ts: str, window: str, delay: str, lang: Column | str | None = "en") -> DataFrame:
    """Token types per time window of a stream with timestamps; documents later than ``delay`` are left out."""
    kinds = docs.withWatermark(ts, delay).select(F.window(ts, window).alias("window"), F.explode(sg.token_types("text", lang)).alias("type"))
    return kinds.groupBy("window", "type").agg(F.count("*").alias("n"))


# --- texts that come in parts -------------------------------------------------------------------------------------


def settled(text: str, lang: str | None) -> tuple[list[list[tuple]], str, int]:
    """The sentences that no continuation of ``text`` can change, the rest, and its byte offset.

    What ends a sentence looks ahead over blanks to the next sign, and signs without blanks between them can be one
    address. So a sentence is settled if another one with a blank in it, behind a sign, follows.
    """
    found = rule_sentences(text, lang)
    data = text.encode()
    starts = [s[0][2] for s in found]
    for k in range(len(found) - 1, 0, -1):
        rest = data[starts[k] :].decode()
        if len(rest.split(None, 1)) > 1 or rest[-1:].isspace():
            return found[:k], rest, starts[k]
    return [], text, 0


def sentences_of_parts(parts: DataFrame, key: str, order: str, lang: str = "en", text: str = "text", idle: str | None = None) -> DataFrame:
    """Rule-based sentences of texts that come in parts, such as the turns of conversations, which line ends join.

    One row per sentence: key, sent_no, offset (bytes, in the whole text), n_tokens, sentence, closed, part. Sentences that
    no later part can change are closed and come once; the last one is open and comes again with each batch that has parts
    of its text, under the ``part`` (the largest ``order`` so far) that it was last seen with. The state of a text is its
    open sentence, its offset and number. Parts are taken by ``order`` within a batch, and batches as they come; missing
    texts are empty. With ``idle`` (as "10 minutes") a text without new parts for so long is closed and forgotten.
    """

    def run(keys, batches, state: GroupState):
        held, offset, number, part = state.get if state.exists else ("", 0, 0, None)
        if state.hasTimedOut:
            state.remove()
            done, rest = rule_sentences(held, lang), ""
        else:
            rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
            for t, at in zip(rows["_text"], rows["_order"], strict=True):
                held += ("\n" if part is not None else "") + (t or "")
                part = int(at) if part is None else max(part, int(at))
            done, rest, moved = settled(held, lang)
        out = []
        for s in done:
            out.append((keys[0], number, offset + s[0][2], len(s), " ".join(t[0] for t in s), True, part))
            number += 1
        if not state.hasTimedOut:
            offset += moved
            for i, s in enumerate(rule_sentences(rest, lang)):
                out.append((keys[0], number + i, offset + s[0][2], len(s), " ".join(t[0] for t in s), False, part))
            state.update((rest, offset, number, part))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["key", "sent_no", "offset", "n_tokens", "sentence", "closed", "part"])

    rows = parts.select(F.col(key).alias("key"), F.col(order).cast("long").alias("_order"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").applyInPandasWithState(
        run, f"key {kind}, sent_no long, offset long, n_tokens long, sentence string, closed boolean, part long", "held string, offset long, number long, part long", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )
    return found.withColumnRenamed("key", key)


def latest(found: DataFrame, key: str) -> DataFrame:
    """What ``sentences_of_parts`` has written so far as one row per sentence: closed ones, and the last state of open ones."""
    last = found.groupBy(key).agg(F.max("part").alias("_last"))
    rows = found.join(last, key).where(F.col("closed") | (F.col("part") == F.col("_last")))
    # A sentence that was open in the last batch of a text may have been closed by a timeout since.
    newest = rows.groupBy(key, "sent_no").agg(F.max_by(F.struct("offset", "n_tokens", "sentence", "closed"), F.struct("closed", "part")).alias("s"))
    return newest.select(key, "sent_no", "s.*")


# --- counts over batches --------------------------------------------------------------------------------------------


def count_batches(candidates: DataFrame, features: tuple[str, ...], folder: str, checkpoint: str) -> StreamingQuery:
    """Count the features of a stream of labelled candidates: one table of counts for each batch, named by its number.

    A batch that is run again replaces its table, so each candidate counts once. ``merged_counts`` adds up the tables.
    """

    def keep(batch: DataFrame, number: int) -> None:
        sbd.feature_counts(batch, features).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return candidates.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, value, n_eos, n_not) over all batches, for ``sbd.model_of``."""
    schema = "feature string, value string, n_eos long, n_not long, batch long"
    return spark.read.schema(schema).parquet(folder).groupBy("feature", "value").agg(F.sum("n_eos").alias("n_eos"), F.sum("n_not").alias("n_not"))


# --- formatted text -------------------------------------------------------------------------------------------------


def write_formatted(values: DataFrame, path: str, end: str = "\n", checkpoint: str | None = None) -> StreamingQuery | None:
    """Write a column of formatted text (see ``functions.formatting``) as it is.

    ``end`` is what every value that isn't empty ends in, by its format (``formatting.common_end``): Spark's text sink
    needs one to part values by. A stream needs a ``checkpoint`` and gives its query. The sink commits files task by task
    and drops those of failed or repeated tasks.
    """
    if not end:
        raise ValueError("values without a common end can't be written as files")
    column = F.col(f"`{values.columns[0]}`")
    values = values.where(column != "").select(F.substring(column, F.lit(1), F.char_length(column) - len(end)).alias("value"))
    if not values.isStreaming:
        values.write.option("lineSep", end).text(path)
        return None
    return values.writeStream.format("text").option("lineSep", end).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
