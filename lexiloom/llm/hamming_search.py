"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and each segment value points to the codes that have it. For a query, segments are
searched with a growing radius s: every code whose distance is below (s + 1) times the number of segments then agrees
with the query in some segment up to s bits, so it has been found. A query is done once its kth verified distance is
covered in that way; the others go on with a larger radius.

A round probes only the values at exactly s bits and adds to what earlier rounds have found. The kth distance found so
far bounds what can still matter, so the join itself drops farther codes and what is kept of a query stays near k rows.

Rows with equal codes are one index entry with their k least ids, since no other can come among the k nearest by
distance and then id; so a code that a third of all rows share is no hot entry. A round is one equi-join of the open
queries' probes with the index, by segment and value.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K, SEGMENT = 10, 16


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, words): one bit per dimension, set where the value is positive, in 16-bit words; null where there is no vector."""
    bit = lambda x: F.when(F.coalesce(x.cast("double"), F.lit(0.0)) > 0, F.lit("1")).otherwise(F.lit("0"))
    text = F.array_join(F.transform("embedding", bit), "")
    width = F.ceil(F.length(text) / SEGMENT) * SEGMENT
    padded = F.rpad(text, width.cast("int"), F.lit("0"))
    words = F.transform(F.sequence(F.lit(0), (width / SEGMENT - 1).cast("int")), lambda i: F.conv(F.substring(padded, i * SEGMENT + 1, F.lit(SEGMENT)), 2, 16))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") > 0, F.transform(words, lambda w: F.conv(w, 16, 10).cast("int"))).alias("words"))


def _distance(a: str, b: str, segments: int) -> F.Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(segments)]).cast("int")


def _masks(bits: int) -> F.Column:
    """All segment values with so many bits, as one constant array."""
    values = (sum(1 << b for b in picked) for picked in combinations(range(SEGMENT), bits))
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _index(codes: DataFrame, k: int) -> DataFrame:
    """(code, words, ids): the codes with their k least ids, taken per part of a code's rows first, so that no task gathers all of them."""
    part = F.row_number().over(Window.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id"))
    rows = codes.withColumn("n", part).where(F.col("n") <= k)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k)
    return rows.groupBy("code").agg(F.first("words").alias("words"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each of ``queries`` the k nearest rows of ``codes``, itself included.

    Both have (vec_id, words). Distance is the Hamming distance; ties are ordered by vec_id. Rows without code or id
    take no part, repeated rows count as often as they stand there, and a query with fewer than k rows to find gets
    those there are. All codes must have the same length. Other columns are not read.
    """
    scratch = Scratch(codes.sparkSession, "hamming")
    code = F.array_join(F.transform("words", lambda w: w.cast("string")), ",").alias("code")
    index = scratch.save(_index(codes.where("vec_id is not null and words is not null").select("vec_id", "words", code), k), "codes")
    entries, rows, m = index.agg(F.count("*"), F.sum(F.size("ids")), F.max(F.size("words"))).first()
    asked = scratch.save(queries.where("vec_id is not null and words is not null").select("vec_id", code, "words"), "asked")
    if not entries or not asked.limit(1).collect():
        return codes.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    enough = min(k, rows)
    segments = index.select("code", F.size("ids").alias("copies"), "words", F.posexplode("words").alias("seg", "value"))
    open_ = asked.groupBy("code").agg(F.first("words").alias("q")).select(F.col("code").alias("query"), "q", F.lit(None).cast("int").alias("bound"))
    open_, near, done, s = scratch.save(open_, "open-0"), None, [], 0
    while open_.limit(1).collect():
        at_s = F.transform(_masks(s), lambda x: x.bitwiseXOR(F.col("v")))
        probes = open_.select("query", "q", "bound", F.posexplode("q").alias("seg", "v")).select("query", "q", "bound", "seg", F.explode(at_s).alias("value"))
        found = probes.hint("merge").join(segments.hint("merge"), ["seg", "value"]).withColumn("distance", _distance("q", "words", m))
        found = found.where("bound is null or distance <= bound").select("query", "code", "copies", "distance")
        found = found if near is None else found.unionByName(near)
        found = found.groupBy("query", "code").agg(F.first("copies").alias("copies"), F.first("distance").alias("distance"))
        # The kth distance: the least one up to which there are k rows. What lies beyond can't be an answer any more.
        upto = F.sum("copies").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("upto") >= enough, F.col("distance"))).over(Window.partitionBy("query"))
        found = found.withColumn("upto", upto).withColumn("bound", bound).where("bound is null or distance <= bound").drop("upto")
        found = scratch.save(found, f"found-{s}")
        covered = F.coalesce(F.col("bound") < m * (s + 1), F.lit(False))
        done.append(found.where(covered).select("query", "code", "distance"))
        near = found.where(~covered).drop("bound")
        bounds = found.groupBy("query").agg(F.min("bound").alias("bound"))
        open_ = scratch.save(open_.drop("bound").join(bounds.hint("merge"), "query", "left").where(~covered), f"open-{s + 1}")
        scratch.drop(f"open-{s}", tidy=False)
        s += 1
    found = reduce(DataFrame.unionByName, done)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    found = found.join(index.select("code", F.explode("ids").alias("vec_id")).hint("merge"), "code").withColumn("rank", rank).where(F.col("rank") <= k)
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(found.drop("code").hint("merge"), "query")
    return out.select("query_id", "rank", "vec_id", "distance")
