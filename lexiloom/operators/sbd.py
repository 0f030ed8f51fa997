"""Sentence-boundary classification of periods by Naive Bayes: features, training, scoring and evaluation in Spark.

Features are columns over the token left of a period (l) and the one right of it (r). Training counts them, a model is
three small tables of log2 probabilities, and scoring joins candidates with them and adds up per class.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import combinations

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charsets as cs
from ..functions.batches import joined_slices
from ..sources.scratch import written

# The features of each language's model, in order.
FEATURES = {
    "de": ("l_case", "l_suffix3", "r_shape"),
    "en": ("l_suffix4", "r_prefix4", "r_shape+l_mask"),
    "fr": ("l_unimask",),
    "it": ("l_case", "l_suffix2", "r_prefix4+r_unimask"),
}
# The model file's format, separator and limits.
MAGIC, SEPARATOR, MAX_FEATURES, MAX_VALUES, MAX_NAME, MAX_BYTES = "mr_bayes 1", "\x01", 254, 15_000, 512, 128
SIDES = [f"{s}_{k}" for s in "lr" for k in ("word", "len", "suffix2", "suffix3", "suffix4", "prefix2", "prefix3", "prefix4", "shape", "case", "mask", "unimask")]


# --- features -----------------------------------------------------------------------------------------------------


def clean_token(text: str) -> str:
    """NFKC without ignorable, unassigned and private characters, guillemets as plain quotes."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text.replace("«", '"').replace("»", '"'))
    drop = [c for c in set(text) if _dropped(c)]
    return text.translate(dict.fromkeys(map(ord, drop))) if drop else text


@lru_cache(1 << 16)
def _dropped(char: str) -> bool:
    """Whether it is ignorable, unassigned or private."""
    return unicodedata.category(char) in ("Cn", "Co") or ord(char) in _IGNORABLE


_IGNORABLE = cs.points("AD 34F 61C 115F-1160 17B4-17B5 180B-180E 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF")


@joined_slices(T.StringType())
def cleaned(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else clean_token(t) for t in text.to_pylist()], pa.string())


@joined_slices(T.StringType())
def unimask(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "".join(map(cs.category_ordinal, t)) for t in text.to_pylist()], pa.string())


def case(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^\p{Lu}")), "LCAP").otherwise("LLOW")


def shape(text: Column, kind: Column) -> Column:
    return F.when(kind == "LATIN", case(text)).otherwise(kind)


def mask(text: Column) -> Column:
    """V for vowels, C for other letters, D for numbers, P for the rest."""
    text = F.regexp_replace(text, r"[^\p{L}\p{N}]", "\x01")
    text = F.regexp_replace(text, r"\p{N}", "\x02")
    text = F.regexp_replace(text, f"[{cs.VOWELS}]", "\x03")
    return F.translate(F.regexp_replace(text, r"\p{L}", "C"), "\x01\x02\x03", "PDV")


def length_bucket(text: Column) -> Column:
    n = F.octet_length(text)
    return F.when(n < 2, n.cast("string")).when(n < 4, "2..3").when(n < 6, "4..5").when(n < 8, "6..7").otherwise("8..")


def feature(name: str, side: str = "") -> Column:
    """A feature by name over columns l, l_type, r and r_type; names joined by + are one compound feature."""
    if "+" in name:
        return F.concat_ws(SEPARATOR, *[feature(n) for n in name.split("+")])
    s, kind = name.split("_", 1)
    text, of_type = F.col(s), F.col(f"{s}_type")
    if kind.startswith("prefix"):
        return F.substring(text, 1, int(kind[6:]))
    if kind.startswith("suffix"):
        return F.right(text, F.lit(int(kind[6:])))
    return {"word": lambda: text, "len": lambda: length_bucket(text), "case": lambda: case(text), "mask": lambda: mask(text), "shape": lambda: shape(text, of_type), "unimask": lambda: unimask(text)}[kind]()


def python_feature(name: str, left: tuple[str, str], right: tuple[str, str]) -> str:
    """The same for one pair of (text, type); used by the sequential splitter."""
    if "+" in name:
        return SEPARATOR.join(python_feature(n, left, right) for n in name.split("+"))
    s, kind = name.split("_", 1)
    text, of_type = left if s == "l" else right
    if kind.startswith("prefix"):
        return text[: int(kind[6:])]
    if kind.startswith("suffix"):
        return text[-int(kind[6:]) :]
    if kind == "unimask":
        return "".join(map(cs.category_ordinal, text))
    if kind == "mask":
        return "".join("V" if c in cs.VOWELS else "C" if unicodedata.category(c)[0] == "L" else "D" if unicodedata.category(c)[0] == "N" else "P" for c in text)
    if kind == "len":
        n = len(text.encode())
        return str(n) if n < 2 else "2..3" if n < 4 else "4..5" if n < 6 else "6..7" if n < 8 else "8.."
    if kind == "word":
        return text
    letter = "LCAP" if text and unicodedata.category(text[0]) == "Lu" else "LLOW"
    return letter if kind == "case" or of_type == "LATIN" else of_type


# --- candidates -----------------------------------------------------------------------------------------------------


def contexts(tokens: DataFrame, keys: list[str], order: str = "seq", carry: list[str] | None = None) -> DataFrame:
    """The periods among ``tokens`` (keys, order, str, type) with two tokens on either side.

    Columns: keys, seq, and str/type of the neighbours as l2, l2_type, l, l_type, r, r_type, r2, r2_type. Beyond the
    ends stand empty UNK tokens. Columns in ``carry`` come along. One shuffle by document.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cols = []
    for name, by in (("l2", 2), ("l", 1), ("r", -1), ("r2", -2)):
        cols += [F.lag("str", by, "").over(w).alias(name), F.lag("type", by, "UNK").over(w).alias(f"{name}_type")]
    return tokens.select(*keys, F.col(order).alias("seq"), "str", "type", *(carry or []), *cols).where(F.col("str") == ".").drop("str", "type")


def contexts_in(tokens: Column, periods: str = ".", offsets: bool = False) -> Column:
    """The same for an array of tokens of one document, without a shuffle: an array of structs of seq and the neighbours.

    periods: the signs that count. offsets: also the byte offsets of the period and of the token after it (-1 at the end).
    """
    at = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i)["str"].isin(*periods))

    def neighbours(i):
        cols = [i.alias("seq")]
        for name, by in (("l2", -2), ("l", -1), ("r", 1), ("r2", 2)):
            token = F.when(i + by >= 0, F.get(tokens, i + by))
            cols += [F.coalesce(token["str"], F.lit("")).alias(name), F.coalesce(token["type"], F.lit("UNK")).alias(f"{name}_type")]
        if offsets:
            cols += [F.get(tokens, i)["offset"].alias("offset"), F.coalesce(F.get(tokens, i + 1)["offset"], F.lit(-1)).alias("r_offset")]
        return F.struct(*cols)

    return F.when(F.size(tokens) > 0, F.transform(at, neighbours))


def labelled_tokens(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of ``sentences`` (keys, sent_no, tok_no, str, type) with ``is_end``: whether the token ends its sentence.

    That is the sentence's closing . ? or !, which only symbols may follow, and its last token if it has none.
    """
    w = Window.partitionBy(*keys, "sent_no")
    mark = F.col("str").isin(".", "?", "!")
    word = F.max(F.when((F.col("type") != "SYM") & ~mark, F.col("tok_no"))).over(w)
    end = F.max(F.when(mark, F.col("tok_no"))).over(w)
    end = F.when(end > F.coalesce(word, F.lit(-1)), end).otherwise(F.max("tok_no").over(w))
    return sentences.withColumn("is_end", F.col("tok_no") == end)


# --- training -------------------------------------------------------------------------------------------------------


@dataclass
class Tables:
    """A model as tables: prior (label, lp), unknown (feature, lp_eos, lp_not), prob (feature, value, lp_eos, lp_not)."""

    prior: DataFrame
    unknown: DataFrame
    prob: DataFrame


def feature_counts(candidates: DataFrame, features: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, value, n_eos, n_not): how often each value of a feature goes with each label."""
    pairs = [F.struct(F.lit(n).alias("feature"), feature(n).alias("value")) for n in features]
    values = candidates.select(*keys, "label", F.explode(F.array(*pairs)).alias("f")).select(*keys, "label", "f.*")
    count = lambda x: F.count(F.when(F.col("label") == x, 1))
    return values.groupBy(*keys, "feature", "value").agg(count("EOS").alias("n_eos"), count("!EOS").alias("n_not"))


def model_of(counts: DataFrame) -> Tables:
    """Smoothed log2 probabilities of counts (feature, value, n_eos, n_not).

    Every candidate has one value of each feature, so the counts of any feature add up to those of the labels.
    """
    sizes = counts.groupBy("feature").agg(F.count("*").alias("v"), F.sum("n_eos").alias("all_eos"), F.sum("n_not").alias("all_not"))  # one row per feature
    lp = lambda n, of: F.log2((n + F.lit(0.5)) / (F.col(of) + 0.5 * F.col("v")))
    unknown = sizes.select("feature", lp(F.lit(0), "all_eos").alias("lp_eos"), lp(F.lit(0), "all_not").alias("lp_not"))
    prob = counts.join(F.broadcast(sizes), "feature").select("feature", "value", lp(F.col("n_eos"), "all_eos").alias("lp_eos"), lp(F.col("n_not"), "all_not").alias("lp_not"))
    labels = sizes.agg(F.max("all_eos").alias("EOS"), F.max("all_not").alias("!EOS"))
    labels = labels.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("n")) for x in ("EOS", "!EOS")])).alias("x"), (F.col("EOS") + F.col("`!EOS`")).alias("total"), ((F.col("EOS") > 0).cast("int") + (F.col("`!EOS`") > 0).cast("int")).alias("k"))
    prior = labels.where("x.n > 0").select("x.label", F.log2((F.col("x.n") + 0.5) / (F.col("total") + 0.5 * F.col("k"))).alias("lp"))
    return Tables(prior, unknown, prob)


def train(candidates: DataFrame, features: tuple[str, ...]) -> Tables:
    """Count labels (EOS, !EOS) and features' values in one pass, and take smoothed log2 probabilities."""
    return model_of(written(feature_counts(candidates, features), "counts"))


def score(candidates: DataFrame, keys: list[str], features: tuple[str, ...], model: Tables) -> DataFrame:
    """(keys, lp_eos, lp_not, is_eos) for each candidate; ties end the sentence, and so do overlong tokens.

    The model's tables are joined by feature and value; unseen values get the feature's unknown probability. They are
    broadcast only if they hold as few values as a model file may.
    """
    pairs = [F.struct(F.lit(n).alias("feature"), feature(n).alias("value")) for n in features]
    long = (F.octet_length("l") > MAX_BYTES) | (F.octet_length("r") > MAX_BYTES)
    rows = candidates.select(*keys, long.alias("long"), F.explode(F.array(*pairs)).alias("f")).select(*keys, "long", "f.*")
    few = model.prob.limit(MAX_VALUES + 1).count() <= MAX_VALUES  # of a table that is written
    prob = F.broadcast(model.prob) if few else model.prob
    unknown = model.unknown.select("feature", F.col("lp_eos").alias("u_eos"), F.col("lp_not").alias("u_not"))
    rows = rows.join(prob, ["feature", "value"], "left").join(F.broadcast(unknown), "feature")
    both = rows.groupBy(*keys).agg(F.max("long").alias("long"), F.sum(F.coalesce("lp_eos", "u_eos")).alias("s_eos"), F.sum(F.coalesce("lp_not", "u_not")).alias("s_not"))
    prior = model.prior.agg(*[F.max(F.when(F.col("label") == x, F.col("lp"))).alias(a) for x, a in (("EOS", "p_eos"), ("!EOS", "p_not"))])
    both = both.join(F.broadcast(prior))
    eos, other = F.col("s_eos") + F.col("p_eos"), F.col("s_not") + F.col("p_not")
    return both.select(*keys, eos.alias("lp_eos"), other.alias("lp_not"), (F.coalesce(eos >= other, other.isNull()) | F.col("long")).alias("is_eos"))


def evaluate(judged: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 of ``judged`` (label, is_eos) in percent, and those of always ending a sentence."""
    true, said = F.col("label") == "EOS", F.col("is_eos")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = judged.agg(F.count("*").alias("n"), n(true & said).alias("tp"), n(~true & said).alias("fp"), n(true & ~said).alias("fn"), n(true).alias("pos"))

    def row(name, tp, fp, fn, right):
        p, r = F.try_divide(tp * 100.0, tp + fp), F.try_divide(tp * 100.0, tp + fn)
        return F.struct(F.lit(name).alias("method"), F.try_divide(right * 100.0, F.col("n")).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))

    c = F.col
    rows = [row("bayes", c("tp"), c("fp"), c("fn"), c("n") - c("fp") - c("fn")), row("always", c("pos"), c("n") - c("pos"), F.lit(0), c("pos"))]
    return sums.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def search_features(rows: DataFrame, keys: list[str], features: tuple[str, ...], most: int = 2) -> DataFrame:
    """Every set of up to ``most`` of the features, judged by cross-validation: features (joined by blanks), n, tp, fp, fn,
    accuracy, precision, recall, f1, in percent.

    rows: keys, fold, label and the neighbours of periods. Naive Bayes adds up what each feature says, so a candidate's
    log-odds by each feature, learned from the other folds, are one small vector, and every set is a sum over it: features
    are counted and joined once, whatever the number of sets. Sums are rounded to nine digits, so ties, which end the
    sentence, don't depend on the order. All counts are kept in one pass with partial sums.
    """
    counts = written(feature_counts(rows, features, ("fold",)), "counts")
    whole = counts.groupBy("feature", "value").agg(F.sum("n_eos").alias("w_eos"), F.sum("n_not").alias("w_not"))
    folds = F.broadcast(counts.groupBy("fold", "feature").agg(F.sum("n_eos").alias("f_eos"), F.sum("n_not").alias("f_not")))  # a row for each fold and feature
    totals = counts.groupBy("feature").agg(F.sum("n_eos").alias("t_eos"), F.sum("n_not").alias("t_not"))
    # A value's counts in the other folds, for each fold in which it occurs; elsewhere it isn't asked for.
    rest = counts.join(whole, ["feature", "value"]).select("fold", "feature", "value", (F.col("w_eos") - F.col("n_eos")).alias("n_eos"), (F.col("w_not") - F.col("n_not")).alias("n_not"))
    # Distinct values in the other folds: all but those that occur in this fold alone.
    only = rest.groupBy("fold", "feature").agg(F.count(F.when((F.col("n_eos") + F.col("n_not")) == 0, 1)).alias("only"))
    values = whole.groupBy("feature").agg(F.count("*").alias("all_values"))
    sizes = folds.join(totals, "feature").join(values, "feature").join(only, ["fold", "feature"])
    sizes = sizes.select("fold", "feature", (F.col("t_eos") - F.col("f_eos")).alias("a_eos"), (F.col("t_not") - F.col("f_not")).alias("a_not"), (F.col("all_values") - F.col("only")).alias("v"))
    lp = lambda n, of: F.log2((n + F.lit(0.5)) / (F.col(of) + 0.5 * F.col("v")))
    odds = rest.join(F.broadcast(sizes), ["fold", "feature"]).select("fold", "feature", "value", (lp(F.col("n_eos"), "a_eos") - lp(F.col("n_not"), "a_not")).alias("odds"))
    prior = sizes.groupBy("fold").agg(F.log2((F.max("a_eos") + 0.5) / (F.max("a_not") + 0.5)).alias("prior"))

    long = (F.octet_length("l") > MAX_BYTES) | (F.octet_length("r") > MAX_BYTES)
    pairs = [F.struct(F.lit(n).alias("feature"), feature(n).alias("value")) for n in features]
    said = rows.select(*keys, "fold", "label", long.alias("long"), F.explode(F.array(*pairs)).alias("f")).select(*keys, "fold", "label", "long", "f.*")
    said = said.join(odds, ["fold", "feature", "value"]).groupBy(*keys, "fold", "label", "long")
    said = said.agg(*[F.max(F.when(F.col("feature") == n, F.col("odds"))).alias(f"o{i}") for i, n in enumerate(features)]).join(F.broadcast(prior), "fold")
    sets = [c for k in range(1, most + 1) for c in combinations(range(len(features)), k)]
    ends = lambda c: (F.round(reduce(lambda x, y: x + y, [F.col(f"o{i}") for i in c], F.col("prior")), 9) >= 0) | F.col("long")
    true = F.col("label") == "EOS"
    n = lambda x: F.count(F.when(x, 1))
    sums = said.agg(F.count("*").alias("n"), *[F.struct(n(ends(c) & true).alias("tp"), n(ends(c) & ~true).alias("fp"), n(~ends(c) & true).alias("fn")).alias(f"s{j}") for j, c in enumerate(sets)])
    names = [" ".join(features[i] for i in c) for c in sets]
    table = sums.select("n", F.explode(F.array(*[F.struct(F.lit(name).alias("features"), F.col(f"s{j}").alias("s")) for j, name in enumerate(names)])).alias("x")).select("x.features", "n", "x.s.*")
    p, r = F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fp")), F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fn"))
    right = F.try_divide((F.col("n") - F.col("fp") - F.col("fn")) * 100.0, F.col("n"))
    return table.select("*", right.alias("accuracy"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def fold(key: Column, folds: int = 5) -> Column:
    """The cross-validation fold of a row: a hash of its key, the same on every engine."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


# --- model files ----------------------------------------------------------------------------------------------------


# The texts of the error kinds, by number; any other number is an unknown error.
ERRORS = ("no error", "cannot find models directory", "cannot open model file", "model file signature mismatch", "model file is corrupt", "cannot read model file")


def error_text(number: int) -> str:
    return ERRORS[number] if 0 <= number < len(ERRORS) else "unknown error"


class ModelError(ValueError):
    """A model that can't be had or made; ``number`` is that of its kind."""

    number = -1

    def __init__(self, text: str | None = None):
        super().__init__(text or error_text(self.number))


class NoModels(ModelError):
    number = 1


class CannotOpen(ModelError):
    number = 2


class WrongModel(ModelError):
    number = 3


class CorruptModel(ModelError):
    number = 4


class CannotRead(ModelError):
    number = 5


@dataclass
class Model:
    """A model in memory: features, log2 priors (EOS, !EOS), unknown probabilities by feature, and those of values."""

    name: str
    features: tuple[str, ...]
    prior: tuple[float, float]
    unknown: list[tuple[float, float]]
    values: dict[tuple[int, str], tuple[float, float]] = field(repr=False)

    def at_end(self, left: tuple, right: tuple) -> bool:
        """Whether the period between two tokens ends the sentence."""
        a, b = (clean_token(left[0]), left[3]), (clean_token(right[0]), right[3])
        if max(len(a[0].encode()), len(b[0].encode())) > MAX_BYTES:
            return True
        eos, other = self.prior
        for i, n in enumerate(self.features):
            p = self.values.get((i, python_feature(n, a, b)), self.unknown[i])
            eos, other = eos + p[0], other + p[1]
        return eos >= other

    def tables(self, spark: SparkSession) -> Tables:
        prior = spark.createDataFrame([("EOS", self.prior[0]), ("!EOS", self.prior[1])], "label string, lp double")
        unknown = spark.createDataFrame([(n, *p) for n, p in zip(self.features, self.unknown, strict=True)], "feature string, lp_eos double, lp_not double")
        prob = spark.createDataFrame([(self.features[i], v, *p) for (i, v), p in self.values.items()], "feature string, value string, lp_eos double, lp_not double")
        return Tables(prior, unknown, prob)

    @staticmethod
    def of(tables: Tables, name: str, features: tuple[str, ...]) -> Model:
        """Bring a trained model of bounded size to the driver."""
        features = tuple(sorted(features))
        at = {n: i for i, n in enumerate(features)}
        prior = {r.label: r.lp for r in tables.prior.collect()}
        unknown = {r.feature: (r.lp_eos, r.lp_not) for r in tables.unknown.collect()}
        rows = tables.prob.limit(MAX_VALUES + 1).collect()
        if len(rows) > MAX_VALUES or len(features) > MAX_FEATURES:
            raise ModelError("the model has more values than a model file can hold")
        if set(prior) != {"EOS", "!EOS"}:
            raise ModelError("both kinds of periods are needed to make a model")
        return Model(name, features, (prior["EOS"], prior["!EOS"]), [unknown[n] for n in features], {(at[r.feature], r.value): (r.lp_eos, r.lp_not) for r in rows})


def _dump(m: Model, version: str) -> bytes:
    out = [f"{MAGIC}\n{m.name} {version}\nfeatures {len(m.features)} values {len(m.values)}\n", f"EOS {m.prior[0].hex()} !EOS {m.prior[1].hex()}\n"]
    out += [f"{len(n.encode())}:{n} {p[0].hex()} {p[1].hex()}\n" for n, p in zip(m.features, m.unknown, strict=True)]
    out += [f"{i} {len(v.encode())}:{v} {p[0].hex()} {p[1].hex()}\n" for (i, v), p in sorted(m.values.items(), key=lambda x: (x[0][0], x[0][1].encode()))]
    return "".join(out).encode()


def dump_model(m: Model) -> bytes:
    """The model as a file; its version is a digest of the rest."""
    return _dump(m, hashlib.sha1(_dump(m, hashlib.sha1(b"foobar").hexdigest())).hexdigest())


def parse_model(data: bytes, name: str | None = None, version: str | None = None) -> Model:
    """Read a model file; raises ModelError where it isn't one, is damaged, or hasn't the name or version asked for."""
    at = 0

    def line() -> str:
        nonlocal at
        end = data.find(b"\n", at)
        if end < 0:
            raise CorruptModel()
        out, at = data[at:end], end + 1
        return out.decode()

    def counted(head: bytes) -> tuple[str, tuple[float, float]]:
        """length:text and two numbers; the text may hold any character."""
        nonlocal at
        colon = data.index(b":", at)
        size = int(data[at:colon].removeprefix(head))
        text = data[colon + 1 : colon + 1 + size].decode()
        at = colon + 1 + size
        a, b = line().split()
        return text, (float.fromhex(a), float.fromhex(b))

    if line() != MAGIC:
        raise WrongModel()
    try:
        own, its_version = line().split()
        if len(own.encode()) > MAX_NAME or name not in (None, own) or version not in (None, its_version):
            raise WrongModel()
        _, f, _, v = line().split()
        n_features, n_values = int(f), int(v)
        if not 0 < n_features <= MAX_FEATURES or not 0 < n_values <= MAX_VALUES:
            raise CorruptModel()
        a, x, b, y = line().split()
        if (a, b) != ("EOS", "!EOS"):
            raise CorruptModel()
        heads = [counted(b"") for _ in range(n_features)]
        values = {}
        for _ in range(n_values):
            space = data.index(b" ", at)
            i = int(data[at:space])
            at = space + 1
            value, p = counted(b"")
            if i >= n_features or (i, value) in values:
                raise CorruptModel()
            values[i, value] = p
    except (ValueError, IndexError) as e:
        raise CorruptModel() from e
    if at != len(data):
        raise CorruptModel()
    if any(len(t.encode()) > MAX_BYTES for _, t in values):
        raise CorruptModel()
    return Model(own, tuple(n for n, _ in heads), (float.fromhex(x), float.fromhex(y)), [p for _, p in heads], values)


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a model from any place that Spark reads. A file that is named after a model must hold that one."""
    rows = _files(spark.read.format("binaryFile"), path, CannotOpen).limit(2)
    found = _content(rows)
    if len(found) != 1:
        raise CannotOpen()
    return _named(found[0])


def load_models(spark: SparkSession, folder: str) -> dict[str, Model]:
    """The models (*.mdl) of a folder by language, which is what their names begin with: de_news.mdl is for de."""
    rows = _files(spark.read.format("binaryFile").option("pathGlobFilter", "*.mdl"), folder, NoModels)
    return {m.name[:2]: m for m in map(_named, _content(rows.orderBy("path")))}  # bounded: a few languages


def _files(reader, path: str, missing: type[ModelError]) -> DataFrame:
    try:
        return reader.load(path).select("path", "content")
    except AnalysisException as e:
        raise missing() from e


def _content(rows: DataFrame) -> list:
    try:
        return rows.collect()
    except (PySparkException, Py4JJavaError) as e:
        raise CannotRead() from e


def _named(row) -> Model:
    model, file = parse_model(bytes(row.content)), row.path.rpartition("/")[2]
    if file.endswith(".mdl") and file != f"{model.name}.mdl":
        raise WrongModel()
    return model
