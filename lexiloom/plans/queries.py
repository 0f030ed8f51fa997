"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import formatting, lexicons
from ..functions import text as tx
from ..functions.batches import bound_batches
from ..operators import judged, properties, ranges, sbd
from ..operators import segment as sg
from ..operators.tokens import TYPES
from ..sources import text as src
from ..sources.scratch import shared_folder, written
from . import cases



def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; one that would be read by fewer tasks than there are cores is dealt out, since segmentation is work for the
    CPU and not for the disk."""
    bound_batches(spark)
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.token_table(_docs(spark, sf_dir).select("doc_id", "lang", "text"), F.col("lang"))


def _words(docs: DataFrame, lang: F.Column | str, *carry: str) -> DataFrame:
    """One row per word (a token of type LATIN)."""
    return docs.select(*carry, F.explode(sg.token_strings("text", lang, "LATIN")).alias("str"))


def token_type_hist(spark, sf_dir):
    kinds = _docs(spark, sf_dir).select("lang", F.explode(sg.token_types("text", F.col("lang"))).alias("type"))
    return kinds.groupBy("lang", "type").agg(F.count("*").alias("n"))


def token_stream(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "seq", "str", "len", "offset", "type")


def token_stream_sql(spark, sf_dir):
    """The table function, from SQL."""
    sg.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    _docs(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"select lang, type, count(*) as n, sum(len) as bytes from tokenize_table(table(select doc_id, lang, text from {view})) group by lang, type")


def conversation_tokens(spark, sf_dir):
    rows = sg.token_table(_docs(spark, sf_dir, "conversations"), "en")
    return rows.groupBy("role", "type").agg(F.count("*").alias("n"), F.countDistinct("str").alias("distinct_tokens"))


def page_tokens(spark, sf_dir):
    rows = sg.token_table(_docs(spark, sf_dir, "pages").select("page_id", "html"), "en", "html")
    return rows.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def part_names(spark, sf_dir):
    """Short texts: the tokens of part names, most frequent first per type."""
    rows = sg.token_table(_docs(spark, sf_dir, "part").select("p_partkey", "p_name"), "en", "p_name")
    return rows.groupBy("str", "type").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


def grapheme_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sg.grapheme_count("text").alias("n_graphemes"))


def grapheme_stream(spark, sf_dir):
    rows = sg.grapheme_table(_docs(spark, sf_dir, "benchmark").select("item_id", "text"))
    return rows.select("item_id", "seq", "str", "len", "offset")


def byte_lengths(spark, sf_dir):
    text = F.col("text")
    cols = [tx.byte_length(text).cast("long").alias("n_bytes"), tx.code_points(text).cast("long").alias("n_points"), tx.byte_offset(text, 10).cast("long").alias("offset_10"), tx.byte_offset(text, -5).cast("long").alias("offset_last_5")]
    return _docs(spark, sf_dir).select("doc_id", *cols)


def text_classes(spark, sf_dir):
    first = F.substring("text", 1, 1)
    cols = [f(first).alias(f.__name__) for f in (tx.is_letter, tx.is_upper, tx.is_lower, tx.is_number, tx.is_space)]
    return _docs(spark, sf_dir).select("doc_id", *cols, F.md5(tx.squeezed("text")).alias("squeezed_md5"))


def normal_forms(spark, sf_dir):
    cols = [F.md5(tx.normalized("text", "NFC")).alias("nfc_md5"), F.md5(tx.strip_diacritics("text")).alias("plain_md5"), F.md5(tx.strip_unknown(tx.strip_ignorable("text"))).alias("stripped_md5")]
    return _docs(spark, sf_dir).select("doc_id", *cols)


def case_folds(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.case_folded("text")).alias("folded_md5"))


def nfc_paragraphs(spark, sf_dir):
    rows = src.paragraph_table(_docs(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "para_no", F.length("text").alias("n_chars"), F.md5("text").alias("para_md5"))


def sentences_fsm(spark, sf_dir):
    rows = sg.sentence_token_table(_docs(spark, sf_dir).select("doc_id", "lang", "text"), F.col("lang"), sbd="fsm")
    return rows.select("doc_id", "sent_no", "tok_no", "str", "len", "offset", "type")


def sentence_len_hist(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("lang", F.explode(sg.sentence_sizes("text", F.col("lang"))).alias("n_tokens"))
    return rows.groupBy("lang", "n_tokens").agg(F.count("*").alias("n"))


def sentence_token_conservation(spark, sf_dir):
    """Sentences hold the characters of the token stream: digests of both, per document."""
    docs = _docs(spark, sf_dir)
    text = lambda xs: F.md5(F.array_join(F.transform(xs, lambda t: t["str"]), ""))
    return docs.select("doc_id", text(sg.tokens("text", F.col("lang"))).alias("tokens_md5"), text(F.flatten(sg.sentences("text", F.col("lang"), "fsm"))).alias("sentences_md5"))


def format_tokens(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.md5(formatting.format_tokens(sg.tokens("text", F.col("lang")), "%s\\t%t\\t%l%%\\n")).alias("text_md5"))


def format_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", formatting.format_sentences(sg.sentences("text", F.col("lang"), "fsm"), "%s ", "|\\n").alias("lines"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Periods with their neighbours. No sentence labels are given, so a weak one stands in: a period ends its sentence
    if a word with a capital follows, or nothing."""
    return _periods(_docs(spark, sf_dir))


def _periods(docs: DataFrame, *carry: str) -> DataFrame:
    found = docs.select("doc_id", *carry, F.explode(sg.period_contexts("text", F.col("lang"))).alias("c")).select("doc_id", *carry, "c.*")
    end = (F.col("r") == "") | F.regexp_like("r", F.lit(r"^\p{Lu}"))
    return found.withColumn("label", F.when(end, "EOS").otherwise("!EOS"))


FEATURES = sbd.FEATURES["en"] + ("l_case", "l_len", "r_mask")


def sbd_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


def sbd_features(spark, sf_dir):
    names = [n for n in sbd.SIDES if not n.endswith("unimask")]
    found = _candidates(spark, sf_dir)
    return found.select("doc_id", "seq", "label", *[sbd.feature(n).alias(n) for n in names])


def nb_train_counts(spark, sf_dir):
    return sbd.feature_counts(_candidates(spark, sf_dir), FEATURES)


def nb_train_model(spark, sf_dir):
    t = sbd.train(_candidates(spark, sf_dir), FEATURES)
    r = lambda c: F.round(c, 9).alias(c)
    rows = t.prob.select(F.lit("value").alias("part"), "feature", "value", r("lp_eos"), r("lp_not"))
    rows = rows.unionByName(t.unknown.select(F.lit("unknown").alias("part"), "feature", F.lit("").alias("value"), r("lp_eos"), r("lp_not")))
    prior = t.prior.agg(*[F.round(F.max(F.when(F.col("label") == x, F.col("lp"))), 9).alias(a) for x, a in (("EOS", "lp_eos"), ("!EOS", "lp_not"))])
    return rows.unionByName(prior.select(F.lit("prior").alias("part"), F.lit("").alias("feature"), F.lit("").alias("value"), "lp_eos", "lp_not"))


def _folds(spark, sf_dir) -> DataFrame:
    """The periods with the fold of their document, written once for training and scoring."""
    return written(_candidates(spark, sf_dir).select("doc_id", "seq", "l", "l_type", "r", "r_type", "label", sbd.fold(F.col("doc_id")).alias("fold")), "candidates")


def _judged(spark, sf_dir) -> DataFrame:
    """Each period judged by a model that was trained on the documents of the other folds, whose counts are added up."""
    rows = _folds(spark, sf_dir)
    counts = written(sbd.feature_counts(rows, FEATURES, ("fold",)), "counts")
    out = None
    for k in range(5):
        rest = counts.where(F.col("fold") != k).groupBy("feature", "value").agg(F.sum("n_eos").alias("n_eos"), F.sum("n_not").alias("n_not"))
        own = sbd.score(rows.where(F.col("fold") == k), ["doc_id", "seq", "label"], FEATURES, sbd.model_of(rest))
        out = own if out is None else out.unionByName(own)
    return out


def nb_score(spark, sf_dir):
    rows = _folds(spark, sf_dir)
    model = sbd.train(rows.where("fold != 0"), FEATURES)
    found = sbd.score(rows.where("fold = 0"), ["doc_id", "seq"], FEATURES, model)
    return found.select("doc_id", "seq", F.round("lp_eos", 6).alias("lp_eos"), F.round("lp_not", 6).alias("lp_not"), "is_eos")


def nb_eval(spark, sf_dir):
    found = sbd.evaluate(_judged(spark, sf_dir))
    return found.select("method", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def sentences_bayes(spark, sf_dir):
    """Sentences by a classifier trained on these documents, whose periods are judged by joins with its tables."""
    features = sbd.FEATURES["de"]
    tables = sbd.train(_candidates(spark, sf_dir), features)
    rows = judged.sentence_tokens(_docs(spark, sf_dir), ["doc_id"], F.col("lang"), features, tables)
    return rows.groupBy("doc_id", "sent_no").agg(F.count("*").cast("int").alias("n_tokens"))


def sentences_by_model_file(spark, sf_dir):
    """The same row by row, with a model that went through its file form."""
    features = sbd.FEATURES["de"]
    tables = sbd.train(_candidates(spark, sf_dir), features)
    model = sbd.parse_model(sbd.dump_model(sbd.Model.of(tables, "own", features)))
    rows = sg.sentence_table(_docs(spark, sf_dir).select("doc_id", "lang", "text"), F.col("lang"), sbd="bayes", model=model)
    return rows.select("doc_id", "sent_no", F.size("tokens").alias("n_tokens"))


def type_rollup_by_lang(spark, sf_dir):
    kinds = _docs(spark, sf_dir).select("lang", F.explode(sg.token_types("text", F.col("lang"))).alias("type"))
    return kinds.rollup("lang", "type").agg(F.count("*").alias("n"))


def top_tokens(spark, sf_dir):
    """The ten most frequent words of each language; a top-k report."""
    n = _words(_docs(spark, sf_dir), F.col("lang"), "lang").groupBy("lang", "str").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "str"))
    return n.withColumn("rank", rank).where("rank <= 10")


def vocab_except(spark, sf_dir):
    """Words of the documents that no benchmark item has."""
    own, items = _words(_docs(spark, sf_dir), F.col("lang")), _words(_docs(spark, sf_dir, "benchmark"), "es")
    return own.distinct().join(items.distinct(), "str", "left_anti")


def vocab_intersect(spark, sf_dir):
    own, items = _words(_docs(spark, sf_dir), F.col("lang")), _words(_docs(spark, sf_dir, "benchmark"), "es")
    return own.intersect(items)


def abbreviation_hits(spark, sf_dir):
    """Tokens before a period that the abbreviation list holds, per language."""
    known = spark.createDataFrame([(w,) for w in lexicons.ABBREVIATIONS.split()], "l string")
    return _periods(_docs(spark, sf_dir), "lang").join(F.broadcast(known), "l", "left_semi").groupBy("lang", "l").agg(F.count("*").alias("n"))


def languages(spark, sf_dir):
    """The documents' languages, and whether they have rules or models of their own."""
    n = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(sg.languages(spark).withColumn("own", F.lit(True))), "lang", "left").select("lang", F.coalesce("own", F.lit(False)).alias("own"), "n")


def type_names(spark, sf_dir):
    """The number of each token's type, and the names of that number and of one beyond all types."""
    kinds = _docs(spark, sf_dir).select(F.explode(sg.token_types("text", F.col("lang"))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    code = (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")) - 1).cast("int")
    return kinds.select(code.alias("code"), sg.type_name(code).alias("name"), sg.type_name(code + 10).alias("beyond"), "n")


def token_micro_batches(spark, sf_dir):
    """Tokens by Structured Streaming, from files to a Parquet table with a checkpoint in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = streaming.token_stream(stream, F.col("lang")).select("doc_id", "seq", "str", "type")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.format("parquet").option("path", f"{root}/tokens").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/tokens")


def _replaced(text: F.Column, pairs) -> F.Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def language_rules(spark, sf_dir):
    """Prefixes, suffixes, word lists, paths, URIs and other kinds of tokens: the documents with words replaced by such."""
    out = None
    for rules, lang in (("en", "en"), ("fr", "fr"), ("it", "es")):
        rows = _docs(spark, sf_dir).where(F.col("lang") == lang).select("doc_id", _replaced(F.col("text"), cases.DERIVED[rules]).alias("text"))
        found = rows.select("doc_id", sg.tokens("text", rules).alias("t"))
        n = lambda kind: F.size(F.filter("t", lambda x: x["type"] == kind)).alias(f"n_{kind.lower()}")
        found = found.select("doc_id", F.md5(F.array_join(F.transform("t", lambda x: F.concat_ws("/", x["str"], x["type"])), " ")).alias("tokens_md5"), *[n(k) for k in ("PREFIX", "SUFFIX", "URI", "PATH")])
        out = found if out is None else out.unionByName(found)
    return out


def _derived_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", _replaced(F.col("text"), cases.DERIVED_SENTENCES).alias("text"))


def sentence_rules(spark, sf_dir):
    """Rule-based sentences of the documents with quotes, brackets, ellipses, abbreviations and paragraphs put in."""
    rows = sg.sentence_token_table(_derived_sentences(spark, sf_dir), F.col("lang"), sbd="fsm")
    return rows.select("doc_id", "sent_no", "tok_no", "str", "len", "offset", "type")


#: A classifier of one feature: a capital behind the period ends the sentence.
CAPITALS = sbd.Model("en_capitals", ("r_case",), (-1.0, -1.0), [(-9.0, -9.0)], {(0, "LCAP"): (-0.1, -4.0), (0, "LLOW"): (-4.0, -0.1)})


def sentence_rules_bayes(spark, sf_dir):
    """The same by a small classifier that was read from its file form, row by row."""
    model = sbd.parse_model(sbd.dump_model(CAPITALS))
    rows = sg.sentence_table(_derived_sentences(spark, sf_dir), F.col("lang"), sbd="bayes", model=model)
    return rows.select("doc_id", "sent_no", F.size("tokens").alias("n_tokens"))


def grapheme_rules(spark, sf_dir):
    """Clusters of the documents with letters replaced by Hangul, emoji, flags, marks and line ends."""
    rows = _docs(spark, sf_dir).select("doc_id", sg.graphemes(_replaced(F.col("text"), cases.DERIVED_CLUSTERS)).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join(F.transform("g", lambda t: t["str"]), "|")).alias("clusters_md5"))


def character_classes(spark, sf_dir):
    """How many signs of the documents, pages and documents with replaced letters are in each class."""
    docs, pages = _docs(spark, sf_dir).select("text"), _docs(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    texts = docs.unionByName(pages).unionByName(docs.select(F.translate("text", *cases.DERIVED_SIGNS).alias("text")))
    signs = texts.select(F.explode(F.split("text", "")).alias("sign")).groupBy("sign").agg(F.count("*").alias("n"))
    of = F.filter(F.array(*[F.when(tx.in_class("sign", F.lit(c)), F.lit(c)) for c in cases.CLASSES]), lambda c: c.isNotNull())
    return signs.select("n", F.explode(of).alias("class")).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("signs"))


def property_counts(spark, sf_dir):
    """How many signs of the documents, pages and documents with Hangul, emoji, flags and marks have each property."""
    docs, pages = _docs(spark, sf_dir).select("text"), _docs(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    texts = docs.unionByName(pages).unionByName(docs.select(_replaced(F.col("text"), cases.DERIVED_CLUSTERS).alias("text")))
    signs = texts.select(F.explode(F.split("text", "")).alias("sign")).groupBy("sign").agg(F.count("*").alias("n"))
    return properties.with_properties(signs, "sign").groupBy("property").agg(F.sum("n").alias("n"), F.count("*").alias("signs"))


def feature_rules(spark, sf_dir):
    """The features of each language's classifier, masks of Unicode categories included."""
    joined = lambda names: F.array_join(F.array(*[F.replace(sbd.feature(n), F.lit(sbd.SEPARATOR), F.lit("/")) for n in names]), "|")
    own = {g: joined(sbd.FEATURES[g]).alias(g) for g in ("de", "en", "fr", "it")}
    return _candidates(spark, sf_dir).select("doc_id", "seq", *own.values(), sbd.feature("l_unimask").alias("l_unimask"), sbd.feature("r_unimask").alias("r_unimask"))


def corpus_tokens(spark, sf_dir):
    """The documents' sentences as a tagged corpus, written, read line by line, and its tokens' labels counted."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    src.write_corpus(sg.sentence_table(_docs(spark, sf_dir), F.col("lang"), sbd="fsm"), path)
    tokens = sbd.labelled_tokens(src.parse_corpus(src.read_lines(spark, path)), ["path"])
    return tokens.groupBy("type", "is_end").agg(F.count("*").alias("n"), F.countDistinct("str").alias("distinct_tokens"))


def corpus_contexts(spark, sf_dir):
    """Labelled periods of that corpus and how many tokens before them have which type."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    src.write_corpus(sg.sentence_table(_docs(spark, sf_dir), F.col("lang"), sbd="fsm").where("size(tokens) > 1"), path)
    found = src.corpus_candidates(src.parse_corpus(src.read_lines(spark, path))).where("tok_no > 0")
    return found.groupBy("l_type", "label").agg(F.count("*").alias("n"))


def text_lines(spark, sf_dir):
    """Lines of the documents, written as text files and read by blocks."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    _docs(spark, sf_dir).select("text").write.text(path)
    return src.read_lines(spark, path).groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


def text_paragraphs(spark, sf_dir):
    """Paragraphs of the documents, written as text files with a blank line between documents and read by blocks."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    _docs(spark, sf_dir).select(F.concat("text", F.lit("\n"))).write.text(path)
    return src.read_paragraphs(spark, path).groupBy(F.md5("text").alias("para_md5")).agg(F.count("*").alias("n"))


def text_rules(spark, sf_dir):
    """Ignorable and unknown code points, compatibility forms, case folding and preparation, put into the documents."""
    rows = _docs(spark, sf_dir).select("doc_id", _replaced(F.col("text"), cases.DERIVED_FORMS).alias("text"))
    forms = {"visible": tx.strip_ignorable("text"), "assigned": tx.strip_unknown("text"), "nfkc": tx.normalized("text", "NFKC"), "folded": tx.case_folded("text"), "prepared": tx.prepared("text"), "cleaned": sbd.cleaned("text")}
    return rows.select("doc_id", *[F.md5(c).alias(f"{n}_md5") for n, c in forms.items()])


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def conversation_sentences(spark, sf_dir):
    """Sentences of conversations whose turns come in three batches, with the open sentence as state between them."""
    rows, root = _docs(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _scratch(spark, "turns")
    for k in range(3):  # batches of turns 0 and 1, then 2 and 3, then the rest
        rows.where(F.least(F.floor(F.col("turn") / 2), F.lit(2)) == k).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        found = streaming.sentences_of_parts(stream, "conv_id", "turn")
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(found.schema).parquet(f"{root}/out")
    return streaming.latest(found, "conv_id").select("conv_id", "sent_no", "offset", "n_tokens", F.md5("sentence").alias("sentence_md5"))


def nb_counts_stream(spark, sf_dir):
    """Training counts of a stream of documents, added up over its batches, which are counted once each."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), _scratch(spark, "counts")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*")
    streaming.count_batches(_periods(stream), FEATURES, f"{root}/counts", f"{root}/state").awaitTermination()
    return streaming.merged_counts(spark, f"{root}/counts")


def formatted_files(spark, sf_dir):
    """Formatted tokens of a stream of documents, written as text and read again."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), _scratch(spark, "formatted")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    fmt = "%t\\t%l\\t%s\\n"
    values = stream.select(formatting.format_tokens(sg.tokens("text", F.col("lang")), fmt).alias("value"))
    streaming.write_formatted(values, f"{root}/out", formatting.common_end(fmt), f"{root}/state").awaitTermination()
    return spark.read.text(f"{root}/out").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def feature_export(spark, sf_dir):
    """The periods' features as a table of text, written and read again; an empty neighbour is a boundary mark there."""
    root = _scratch(spark, "features")
    src.write_features(_candidates(spark, sf_dir), root)
    names = ["label", *sbd.SIDES]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").csv(root)
    boundary = F.count(F.when(F.col("r_word") == "***BOUNDARY***", 1)).alias("boundaries")
    return rows.groupBy("label", "l_case", "r_shape").agg(F.count("*").alias("n"), boundary, F.countDistinct("l_word").alias("words"), F.countDistinct("r_mask").alias("masks"))


def token_graphemes(spark, sf_dir):
    """How many grapheme clusters lie in tokens of each type, by a join of byte ranges."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    clusters = sg.grapheme_table(docs.select("doc_id", "text")).select("doc_id", "offset", "len")
    found = ranges.contained(clusters, _tokens(spark, sf_dir).select("doc_id", "seq", "type", "offset", "len"), ["doc_id"])
    per_token = found.groupBy("doc_id", "seq", "type").agg(F.count("*").alias("clusters"), F.sum("inner_len").alias("bytes"))
    return per_token.groupBy("type").agg(F.count("*").alias("tokens"), F.sum("clusters").alias("clusters"), F.sum("bytes").alias("bytes"))


def feature_search(spark, sf_dir):
    """All sets of one or two features, judged by cross-validation from one table of log-odds."""
    found = sbd.search_features(_folds(spark, sf_dir), ["doc_id", "seq"], SEARCHED, most=2)
    return found.select("features", "n", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1")])


#: Features among which ``feature_search`` looks.
SEARCHED = ("l_case", "l_len", "l_shape", "l_suffix2", "l_suffix3", "r_len", "r_mask", "r_prefix2", "r_shape")


def model_file(spark, sf_dir):
    """A classifier's probabilities after a round trip through its file."""
    features = ("l_case", "l_len")
    model = sbd.Model.of(sbd.train(_candidates(spark, sf_dir), features), "own", features)
    found = sbd.parse_model(sbd.dump_model(model), name="own").tables(spark)
    return found.prob.select("feature", "value", *[F.round(c, 9).alias(c) for c in ("lp_eos", "lp_not")])


def cleaned_tokens(spark, sf_dir):
    """Tokens as the classifier sees them: compatibility forms without control and ignorable signs; those that change or all alike."""
    rows = _tokens(spark, sf_dir).select("type", "str", sbd.cleaned("str").alias("clean"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.octet_length("clean")).alias("bytes"))


def type_counts_stream(spark, sf_dir):
    """Token types per hour of a stream of events with a watermark, in append mode: windows that are closed by the end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    rows = streaming.type_counts(stream, "ts", "1 hour", "10 minutes")
    rows = rows.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "type", "n")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.format("parquet").option("path", f"{root}/counts").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/counts")


QUERIES = {
    f.__name__: f
    for f in (
        token_type_hist, token_stream, token_stream_sql, conversation_tokens, page_tokens, part_names, grapheme_counts,
        grapheme_stream, byte_lengths, text_classes, normal_forms, case_folds, nfc_paragraphs, sentences_fsm,
        sentence_len_hist, sentence_token_conservation, format_tokens, format_sentences, sbd_candidates, sbd_features,
        nb_train_counts, nb_train_model, nb_score, nb_eval, sentences_bayes, sentences_by_model_file, type_rollup_by_lang, top_tokens, vocab_except,
        vocab_intersect, abbreviation_hits, languages, type_names, token_micro_batches,
        language_rules, sentence_rules, sentence_rules_bayes, grapheme_rules, character_classes, feature_rules, corpus_tokens, text_rules,
        corpus_contexts, text_lines, text_paragraphs,
        conversation_sentences, nb_counts_stream, formatted_files, token_graphemes, feature_search, property_counts, feature_export,
        model_file, cleaned_tokens, type_counts_stream,
    )
}
