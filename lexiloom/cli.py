"""Command line: segment text files. For example: spark-submit -m lexiloom.cli -m token -l fr -f '%s %t\\n' in.txt out"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from .functions import formatting
from .functions import text as tx
from .operators import sbd
from .operators import segment as sg
from .sources import text as src
from .streaming import write_formatted

VERSION = "0.1"


def formatted(docs: DataFrame, mode: str, config: str, fmt: str, end: str, model=None) -> DataFrame:
    """(path, para_no, value): each paragraph of ``docs`` (path, para_no, text), segmented and written out."""
    rows = docs.withColumn("text", tx.prepared("text"))
    lang, kind = sg.parse_config(config)
    if mode == "sentence":
        found = sg.sentences("text", lang, kind if lang in ("de", "en", "fr", "it") else "fsm", model)
        value = formatting.format_sentences(found, fmt, end)
    else:
        value = formatting.format_tokens(sg.graphemes("text") if mode == "grapheme" else sg.tokens("text", lang), fmt)
    return rows.select("path", "para_no", value.alias("value"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-m", "--mode", choices=("sentence", "token", "grapheme"), default="sentence")
    p.add_argument("-l", "--lang", default="en", help="language, and perhaps the splitter: 'fr', 'de fsm'")
    p.add_argument("-f", "--format", default="%s\\n", help="how to write a token")
    p.add_argument("-e", "--eos", default="\\n", help="what to write after a sentence")
    p.add_argument("-L", "--list", action="store_true", help="list the languages")
    p.add_argument("--model", default=os.environ.get("LEXILOOM_MODEL"), help="model file for the bayes splitter, or a folder with one for each language")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?", help="folder for the result; printed where there is none")
    a = p.parse_args(argv)
    if a.list:
        print("\n".join(("de", "en", "fr", "it")))
        return
    if not a.input:
        p.error("an input path is needed")
    spark = SparkSession.builder.getOrCreate()
    model = None if not a.model else sbd.load_model(spark, a.model) if a.model.endswith(".mdl") else sbd.load_models(spark, a.model)
    out = formatted(src.read_paragraphs(spark, a.input), a.mode, a.lang, a.format, a.eos, model)
    out = out.orderBy("path", "para_no").select("value")
    if a.output:
        write_formatted(out, a.output, formatting.common_end(a.format, a.eos if a.mode == "sentence" else None))
    else:
        for row in out.toLocalIterator():
            print(row.value, end="")


if __name__ == "__main__":
    main()
