"""A byte-level convolutional quality classifier in numpy.

Every byte has a learned vector; learned filters of 12 bytes move over the document in steps of 4. Their largest
responses within each 256-byte chunk (chunks overlap by half and cover the whole document) pass through a small
hidden layer, the largest hidden values over all chunks are combined into one probability. Short documents are one
chunk; how full a chunk is counts as one more input.

The model is fitted on the driver on at most ``sample`` labelled rows of ``SAMPLE_BYTES`` or less each, picked by a
hash of their id, with a fixed number of steps, so fitting costs the same at any corpus size; scoring is one narrow
pass over all texts, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

DIM, BLOCK, TAPS, FILTERS, HIDDEN, HOP = 8, 4, 3, 32, 16, 128
SAMPLE, STEPS, BATCH, THRESHOLD = 4096, 800, 24, 0.3
#: Longer texts take no part in fitting, which bounds what the driver holds.
SAMPLE_BYTES = 1 << 16
#: Bytes that are scored at once; a longer document is taken alone.
AT_ONCE = 1 << 18

Model = dict[str, np.ndarray]


def new_model(seed: int = 5) -> Model:
    r = np.random.default_rng(seed)
    shape = {"bytes": (257, DIM), "filters": (BLOCK * DIM, TAPS * FILTERS), "bias": (FILTERS,), "hidden": (FILTERS + 1, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
    scale = {"bytes": 1.0, "filters": (BLOCK * DIM * TAPS) ** -0.5, "hidden": FILTERS**-0.5, "out": HIDDEN**-0.5}
    m = {k: (r.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shape.items()}
    m["bytes"][256] = 0  # padding
    return m


def _layout(texts: list[bytes]):
    """The texts in one array, each padded to whole hops with at least two empty blocks at its end."""
    size = np.array([len(t) for t in texts])
    hops = (size + (TAPS - 1) * BLOCK) // HOP + 1
    data = np.full(int(hops.sum()) * HOP, 256, np.int16)
    start = (np.cumsum(hops) - hops) * HOP
    for t, s in zip(texts, start.tolist(), strict=True):
        data[s : s + len(t)] = np.frombuffer(t, np.uint8)
    return data, size, hops, start


def _forward(m: Model, texts: list[bytes], keep: bool = False):
    data, size, hops, start = _layout(texts)
    blocks = m["bytes"][data].reshape(-1, BLOCK * DIM)
    part = blocks @ m["filters"]
    y = part[:, :FILTERS].copy()
    for j in range(1, TAPS):
        y[:-j] += part[j:, j * FILTERS : (j + 1) * FILTERS]
    y += m["bias"]
    np.maximum(y, 0, out=y)
    y *= (data[::BLOCK] != 256)[:, None]
    per = HOP // BLOCK
    cube = y.reshape(-1, per, FILTERS)
    hop_max = cube.max(axis=1)
    # Chunk k of a document spans its hops k and k + 1; a document of one hop is one chunk.
    n = np.maximum(1, hops - 1)
    owner = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    left = (start // HOP)[owner] + k
    right = np.where(hops[owner] > 1, left + 1, left)
    fill = np.minimum(2 * HOP, size[owner] - k * HOP) / np.float32(2 * HOP)
    chunk = np.concatenate([np.maximum(hop_max[left], hop_max[right]), fill[:, None].astype(np.float32)], axis=1)
    h = np.maximum(0, chunk @ m["hidden"] + m["hidden_bias"])
    first = np.cumsum(n) - n
    doc = np.maximum.reduceat(h, first, axis=0)
    logit = doc @ m["out"] + m["out_bias"][0]
    return (logit, data, blocks, cube, hop_max, left, right, owner, chunk, h, first, n, doc) if keep else logit


def _gradients(m: Model, texts: list[bytes], label: np.ndarray) -> Model:
    logit, data, blocks, cube, hop_max, left, right, owner, chunk, h, first, n, doc = _forward(m, texts, True)
    g = {k: np.zeros_like(v) for k, v in m.items()}
    d = ((1 / (1 + np.exp(-logit)) - label) / len(texts)).astype(np.float32)
    g["out"], g["out_bias"][0] = doc.T @ d, d.sum()
    d_doc = d[:, None] * m["out"]
    # Each hidden unit's gradient goes to the chunk of its document where it is largest.
    is_max = (h == doc[owner]) & (h > 0)
    turn = np.cumsum(is_max, axis=0)
    d_h = np.where(is_max & (turn - np.concatenate([np.zeros((1, HIDDEN), int), turn])[first][owner] == 1), d_doc[owner], 0)
    g["hidden"], g["hidden_bias"] = chunk.T @ d_h, d_h.sum(axis=0)
    d_chunk = (d_h @ m["hidden"].T)[:, :FILTERS]
    rows = np.flatnonzero(d_h.any(axis=1))
    if not len(rows):
        return g
    hop = np.where(hop_max[left[rows]] >= hop_max[right[rows]], left[rows][:, None], right[rows][:, None])
    f = np.broadcast_to(np.arange(FILTERS), hop.shape)
    value = hop_max[hop, f]
    at = hop * (HOP // BLOCK) + np.stack([cube[x].argmax(axis=0)[np.arange(FILTERS)] for x in hop.ravel()]).reshape(*hop.shape, FILTERS)[np.arange(len(rows))[:, None], f, f]
    live = value > 0
    where, inverse = np.unique(at[live], return_inverse=True)
    d_y = np.zeros((len(where), FILTERS), np.float32)
    np.add.at(d_y, (inverse, f[live]), d_chunk[rows][live])
    g["bias"] = d_y.sum(axis=0)
    for j in range(TAPS):
        src = np.minimum(where + j, len(blocks) - 1)
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        g["filters"][:, cols] = blocks[src].T @ d_y
        np.add.at(g["bytes"], data.reshape(-1, BLOCK)[src].ravel(), (d_y @ m["filters"][:, cols].T).reshape(-1, DIM))
    g["bytes"][256] = 0
    return g


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, rate: float = 0.004, seed: int = 5) -> Model | None:
    """Adam on balanced batches, corrected to the sample's share of labels; None without both labels."""
    y = np.array(labels, np.float32)
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    if not all(map(len, sides)):
        return None
    m, r = new_model(seed), np.random.default_rng(seed)
    a, b = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for t in range(1, steps + 1):
        pick = np.concatenate([r.choice(s, batch // 2) for s in sides])
        g = _gradients(m, [texts[i] for i in pick], y[pick])
        now = rate * min(1, 2 * (1 - t / (steps + 1)))
        for k in m:
            a[k] = 0.9 * a[k] + 0.1 * g[k]
            b[k] = 0.99 * b[k] + 0.01 * g[k] ** 2
            m[k] = m[k] - np.float32(now) * (a[k] / (1 - 0.9**t)) / (np.sqrt(b[k] / (1 - 0.99**t)) + 1e-8)
    m["out_bias"] = m["out_bias"] + np.float32(np.log(len(sides[1]) / len(sides[0])))
    return m


def score(m: Model | None, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; a half where there is no model."""
    if m is None or not texts:
        return np.full(len(texts), 0.5)
    out, held, size = [], [], 0
    for t in [*texts, None]:
        if held and (t is None or size + len(t) > AT_ONCE):
            out.append(_forward(m, held))
            held, size = [], 0
        if t is not None:
            held.append(t)
            size += len(t)
    return 1 / (1 + np.exp(-np.concatenate(out).astype(np.float64)))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """Fit on at most ``sample`` labelled rows that aren't held out. Rows without id or label are left aside."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    marks = marks.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.md5(F.col("doc_id").cast("string"))
    marks = marks.orderBy(order, "doc_id").limit(sample)  # the documented bound of the fitting sample
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([(r.text or "").encode() for r in rows], [r.y for r in rows], steps)


def scores(text, model: Model | None) -> F.Column:
    """The score of each text as a column; a missing text counts as empty."""

    @F.pandas_udf("double")
    def of(text):
        import pandas as pd

        return pd.Series(score(model, [(t or "").encode() for t in text]))

    return of(text.cast("string"))


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` plus ``score`` and ``predicted``; columns of these names are replaced.

    The score depends on the whole text alone; a missing text counts as empty.
    """
    bound_batches(docs.sparkSession)
    out = docs.withColumn("score", scores(F.col("text"), model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
