"""Tokens as text by a format string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\"}


def _parts(fmt: str) -> list[tuple[str, str]]:
    """The format as ("text", literal) and ("field", letter); unknown escapes stand for themselves."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two[0] == "%" and two[1:] in ("s", "t", "l"):
            out.append(("field", two[1]))
            i += 2
        elif two == "%%":
            out.append(("text", "%"))
            i += 2
        elif two[0] == "\\" and two[1:] in _ESCAPES:
            out.append(("text", _ESCAPES[two[1]]))
            i += 2
        else:
            out.append(("text", fmt[i]))
            i += 1
    return out


def unescaped(text: str) -> str:
    """A string with its backslash escapes resolved."""
    return "".join(x for _, x in _parts(text.replace("%", "%%")))


def common_end(fmt: str, end: str | None = None) -> str:
    """The sign that everything formatted so ends in, tokens or (with ``end``) sentences; empty if there is none."""
    for text in (unescaped(end or ""), fmt):
        parts = [("text", text)] if text is not fmt else _parts(fmt)
        if parts and parts[-1][1]:
            return parts[-1][1][-1] if parts[-1][0] == "text" else ""
    return ""


def format_token(text: Column, kind: Column, length: Column, fmt: str = "%s\\n") -> Column:
    """%s the token with its blanks squeezed, %t its type, %l its length in bytes, %% a percent sign; \\n, \\t, \\\\."""
    of = {"s": lambda: squeezed(text), "t": lambda: kind, "l": lambda: length.cast("string")}
    return F.concat(F.lit(""), *[F.lit(x) if what == "text" else of[x]() for what, x in _parts(fmt)])


def format_tokens(tokens: Column, fmt: str = "%s\\n") -> Column:
    """An array of tokens as one text."""
    return F.array_join(F.transform(tokens, lambda t: format_token(t["str"], t["type"], t["len"], fmt)), "")


def format_sentences(sentences: Column, fmt: str = "%s\\n", end: str = "\\n") -> Column:
    """An array of sentences as one text, with ``end`` after each."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(format_tokens(s, fmt), F.lit(unescaped(end)))), "")
