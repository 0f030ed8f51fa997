"""Document fingerprints by winnowing: of the k-gram hashes of a text, the least one of every window, and where it stands.

Units are words, long ones in pieces, and a gram's hash is the polynomial over its units' CRC-32 values modulo a prime.
It rolls by doubling: grams of 2 s units come from two of s units that lie side by side. The least of a window is taken
by doubling, too, over values that hold the hash above and the place, counted from the end, below: so the rightmost of
equal hashes wins. Whatever two texts share of ``k + window - 1`` units in a row, they share a fingerprint of, at
known places in both.

All of it is array functions over a row's own arrays; each step is a projection of its own, so nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 4, 8
UNIT = r"[^\x20\x09-\x0D]{1,16}"
#: Modulus and base of gram hashes; products of a CRC-32 and the base stay below 2**62.
PRIME, BASE = 2_147_483_647, 536_870_923

#: Buckets of neighbouring ids: about so many rows each, until there are so many buckets; those for missing ids.
BUCKET_ROWS, MOST_BUCKETS, NULL_BUCKETS = 256, 1 << 15, 256

_PLACES = 1 << 32
_FP = "_fp_"


def _beside(left: Column, right: Column, skip: int, both) -> Column:
    """both(x, y) of each entry of ``left`` and the one of ``right`` that stands ``skip`` further."""
    n = F.greatest(F.size(left) - skip, F.lit(0)) if left is right else F.greatest(F.least(F.size(left), F.size(right) - skip), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(skip + 1), n), both)


def _rolled(factor: int):
    """Joins the hashes of two neighbouring grams; factor: the base to the power of the right one's length."""
    return lambda a, b: (a % PRIME * F.lit(factor).cast("long") + b) % PRIME


def fingerprinted(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with one more column ``name``: the fingerprint of column ``text``, an array of longs for ``spread``.

    A text of fewer than ``gram`` units has one gram, one of fewer than ``window`` grams one window; missing texts and
    those without units have an empty fingerprint. Inner columns have names that begin with _fp_.
    """
    col = lambda c: F.col(_FP + c)
    put = lambda d, c, x: d.withColumn(_FP + c, x)
    df = put(df, "units", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)))
    df = put(df, "power", F.transform(col("units"), lambda u: F.crc32(u.cast("binary"))))
    df = put(df, "short", F.when(F.size(col("units")).between(1, gram - 1), F.aggregate(col("power"), F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)))
    # Binary digits of the gram's length, from the least: powers of two are doubled, those that it has are put together.
    size, done, first = 1, 0, True
    while size <= gram:
        if gram & size:
            if first:
                df, first = put(df, "grams", col("power")), False
            else:
                df = put(df, "grams", _beside(col("grams"), col("power"), done, _rolled(pow(BASE, size, PRIME))))
            done += size
        if 2 * size <= gram:
            own = col("power")
            df = put(df, "power", _beside(own, own, size, _rolled(pow(BASE, size, PRIME))))
        size *= 2
    grams = F.when(col("short").isNotNull(), F.array(col("short"))).otherwise(col("grams"))
    df = put(df, "grams", F.transform(grams, lambda x, i: x % PRIME * _PLACES + (_PLACES - 1 - i)))
    df = put(df, "one", F.when(F.size(col("grams")).between(1, window), F.array(F.array_min(col("grams")))))
    df, size = put(df, "least", F.when(col("one").isNull(), col("grams"))), 1
    while 2 * size <= window:
        own = col("least")
        df, size = put(df, "least", _beside(own, own, size, lambda a, b: F.least(a, b))), 2 * size
    if size < window:
        own = col("least")
        df = put(df, "least", _beside(own, own, window - size, lambda a, b: F.least(a, b)))
    df = df.withColumn(name, F.array_distinct(F.coalesce(col("one"), col("least"))))
    return df.drop(*[_FP + c for c in ("units", "power", "short", "grams", "one", "least")])


def gram_hash(value: Column) -> Column:
    return F.shiftright(value, 32)


def spread(fingerprint: Column) -> Column:
    """A fingerprint as an array of (hash, position), by position; positions count grams."""
    return F.transform(fingerprint, lambda v: F.struct(gram_hash(v).alias("hash"), (_PLACES - 1 - v.bitwiseAND(_PLACES - 1)).cast("int").alias("position")))


def described(fingerprint: Column) -> Column:
    """A fingerprint as text: hash:position, hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(spread(fingerprint), lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["position"])), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared over all hashes of two fingerprints; two empty ones are alike."""
    a, b = (F.transform(x, gram_hash) for x in (a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, looked up in steps of 64."""
    at, step = F.lit(0), 64 * 64
    while step:
        level = bounds[step - 1 :: step]
        own = F.slice(F.lit(level), at * 64 + 1, F.lit(max(len(level), 1) if step == 64 * 64 else 64)) if level else F.array().cast("array<long>")
        at = at * 64 + F.size(F.filter(own, lambda b: b <= value))
        step //= 64
    return at


def with_next(docs: DataFrame, prepare, carry: list[str]) -> DataFrame:
    """``docs`` (doc_id and other columns, text among them), by ``prepare``, each row with the columns ``carry`` of the
    next one as next_...: in descending order of doc_id, missing ones last, equal ones by their text's hash; after the
    last row comes the first.

    Rows are dealt out by ranges of ids of like numbers of rows, with one shuffle of the texts; the first row of each
    range is also sent to the one before it. ``prepare`` adds columns to the dealt rows.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_next_h", F.xxhash64("text"))
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("b")).first().b if shares else []
    null = F.shiftright("_next_h", 56) + 128
    rows = rows.withColumn("_next_bucket", F.when(F.col("doc_id").isNull(), null.cast("int")).otherwise(_below(F.col("doc_id"), sorted(set(bounds or []))) + NULL_BUCKETS))
    heads = rows.groupBy("_next_bucket").agg(F.max(F.struct("doc_id", "_next_h")).alias("x")).orderBy(F.desc("_next_bucket")).collect()  # one for each bucket
    to = [(h.x.doc_id, h.x._next_h, h._next_bucket, heads[i - 1]._next_bucket) for i, h in enumerate(heads)]  # the first goes to the last
    guests = spark.createDataFrame(to, "_g_id long, _g_h long, _g_from int, _g_to int")
    same = F.col("doc_id").eqNullSafe(F.col("_g_id")) & (F.col("_next_h") == F.col("_g_h")) & (F.col("_next_bucket") == F.col("_g_from"))
    guests = rows.join(F.broadcast(guests), same).withColumn("_next_bucket", F.col("_g_to")).drop("_g_id", "_g_h", "_g_from", "_g_to")
    rows = rows.withColumn("_next_guest", F.lit(False)).unionByName(guests.withColumn("_next_guest", F.lit(True)))
    order = [F.asc("_next_guest"), F.desc_nulls_last("doc_id"), F.desc("_next_h")]
    rows = prepare(rows.repartition("_next_bucket").sortWithinPartitions("_next_bucket", *order))
    window = Window.partitionBy("_next_bucket").orderBy(*order)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in carry})
    return rows.where(~F.col("_next_guest")).drop("_next_bucket", "_next_guest", "_next_h")


def compared_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next.

    edited is the text whose last half (rounded down) is replaced by as many code points of the beginning of the next
    text, or all it has; the likeness of the fingerprint to that text's and to the next one's follows. A missing text
    is empty. Rows come in descending order of doc_id, and the first follows the last; repeated rows stand next to each
    other, so they are alike. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, lambda d: fingerprinted(d, "text", "fingerprint", gram, window), ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.drop("text", "next_text")
    rows = fingerprinted(rows, "edited", "edited_fingerprint", gram, window)
    near = likeness(F.col("fingerprint"), F.col("edited_fingerprint")), likeness(F.col("fingerprint"), F.col("next_fingerprint"))
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))
