"""Typed tokens: at each place the longest of the patterns wins, the first of equally long ones.

The patterns are written so that each one's greedy match is its longest; the scanner is a small helper that Spark
runs in Arrow batches within a narrow stage. Offsets and lengths count UTF-8 bytes.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache

from ..functions import charsets as cs
from ..functions import lexicons

TYPES = ("UNK", "LATIN", "PREFIX", "SUFFIX", "SYM", "NUM", "ABBR", "EMAIL", "URI", "PATH")
LANGUAGES = ("de", "en", "fr", "it")
BOM = "\ufeff"

_L, _A, _N = cs.LATIN, cs.LETTER, cs.NONBLANK
_CHUNK = f"(?:(?:{cs.APOSTROPHE}|{cs.HYPHEN}|{cs.PERIOD}{cs.HYPHEN}?|&){_L}+)"
_TAIL = f"{_CHUNK}*[²³°]?"
_DIRS = "bin|boot|dev|etc|home|lib|media|mnt|opt|proc|root|run|sbin|srv|sys|tmp|usr|var"
_SINGLES = ",;:!?" + cs.PERIODS + "…'‘’‚\"“„«‹”»›()\\[\\]{}$£€©\\-‐‑﹣‒–—﹘⸺⸻−+*^/%&~=><"
_OTHER = f"[^{_SINGLES}`0-9{cs.RAW[1:-1]}{cs.HORIZONTAL}{cs.NEWLINE}]"

SYMBOL = rf"{cs.ELLIPSIS}|\?+|!+|``|''|<<|>>|>=|<=|-+|\++|\*+|/+|=+|[{_SINGLES}]"
PATH = rf"(?:(?:~|\.{{1,2}})/{_N}+{_L}|/(?:{_DIRS})(?:/{_N}+{_L})?)/?"
ABBREVIATION = f"{_A}{{1,2}}(?:{cs.PERIOD}{cs.HYPHEN}?{_A})+"
_SIGN, _H = f"(?:{cs.MINUS}|\\+)", f"[{cs.HORIZONTAL}]"
NUMBERS = (
    rf"{_SIGN}?[0-9]+(?:(?:{cs.PERIOD}|,|{_H}+)[0-9]+)*(?:[eE]{_SIGN}?[0-9]+)?",
    rf"(?:(?:19|20)[0-9]|[1-9])0{cs.APOSTROPHE}[sS]",
    r"0[xX][0-9a-fA-F]+",
    rf"[0-9]+(?::|{cs.DASH}|{cs.HYPHEN})[0-9]+",
)
WORDS = (
    f"°?{_L}+{_TAIL}",
    rf"\({_A}{_L}*\){cs.HYPHEN}?{_L}+{_TAIL}",
    rf"{_L}+{_CHUNK}*{cs.HYPHEN}?\({_A}{_L}*\)(?:{cs.HYPHEN}?{_L}+{_TAIL})?",
    f"{cs.OPEN_DOUBLE}{_L}+{_CHUNK}*{cs.CLOSE_DOUBLE}{cs.HYPHEN}{_L}+{_CHUNK}*",
)
UNKNOWN = f"(?:`(?:{_OTHER}+`?)*|(?:{_OTHER}+`?)+)"
ASSIMILATION = f"{cs.APOSTROPHE}(?i:tis|twas|twill|twere|twould)"
_ASCII_LETTERS, _DIGITS = frozenset(string.ascii_letters), frozenset(string.digits)
#: Signs that begin nothing longer than themselves or a run of them; a bounded number, since the end of a run is looked at.
_SIGNS = r"[%&$*!?#|]{1,64}+"
_LETTERS, _END = "[A-Za-zÀ-ÖØ-öø-ÿ]++", r"(?:[ \n]|\Z)"
#: Blanks and what no other pattern can be longer than: a plain word before a blank or the end, perhaps with common signs
#: between; such signs before a blank or the end, of which none makes an address, a path or dots in a row.
_PLAIN = re.compile(
    rf"[ \n]*+(?:({_LETTERS})(?=[,;:!?.]?(?:{_SIGNS})?{_END})|([,;:](?=(?:{_SIGNS})?{_END})|\.(?=\n|\Z| (?!\.)|{_SIGNS}{_END})|!++(?={_END}))|({_SIGNS})(?={_END}))"
)
#: Plain words and common signs in a row, without periods, and its tokens.
_STRETCH = re.compile(rf"(?:[ \n]*+(?:{_LETTERS}[,;:]?+(?:{_SIGNS})?+|{_SIGNS})(?={_END})){{2,}}+")
_PART = re.compile(rf"{_LETTERS}|[#|]+|\?+|!+|\*+|[%&$,;:]")
#: The rest of a run of signs in which no path can end, looked at once.
_HERE = re.compile(rf"(?:~|\.{{1,2}})/{_N}*")


class Mail:
    """E-mail addresses of a text: a run of signs with an @ inside, a sign behind it, and later a period with letters.

    The longest one from a place on ends at the run's last such letters, if an @ stands well before them. Both are
    looked up once for a run, so a long run costs no more than in proportion.
    """

    _RUN, _END = re.compile(f"{_N}+"), re.compile(rf"\.{_A}+")

    def __init__(self, text: str, end: int | None = None):
        self.text, self.stop = text, len(text) if end is None else end
        self.any = text.find("@", 0, self.stop) >= 0
        self.run_end = self.at = self.period = self.end = -1

    def match(self, at: int) -> int:
        """End of the address that begins here; ``at`` itself if there is none. Places must not decrease."""
        if not self.any:
            return at
        if at >= self.run_end:
            m = self._RUN.match(self.text, at, self.stop)
            if not m:
                return at
            self.run_end, self.at, self.period = m.end(), -1, -1
            if self.text.find("@", at, self.run_end) >= 0:
                for x in self._END.finditer(self.text, at, self.run_end):
                    self.period, self.end = x.span()
        if self.period < 0:
            return at
        if self.at <= at:
            self.at = self.text.find("@", at + 1, self.run_end)
            if self.at < 0:
                self.period = -1
        return self.end if 0 <= self.at <= self.period - 2 else at


class Links:
    """URIs of a text: www. or ftp. with a later period and letters, or a scheme with a letter, digit or slash at the end.

    The first kind takes the rest of its run of signs, the second ends at the run's last letter, digit or slash. Both
    ends are looked up once for a run. Places must not decrease.
    """

    _HEAD, _SCHEME = re.compile(r"[wW]{3}\.|[fF][tT][pP]\."), re.compile("[A-Za-z]+://")
    _RUN, _DOT, _LAST = re.compile(f"{_N}+"), re.compile(r"\.[A-Za-z]"), re.compile("[A-Za-z0-9/]")

    def __init__(self, text: str, end: int | None = None):
        self.text, self.stop = text, len(text) if end is None else end
        self.run_end = self.dot = self.last = -1

    def _run(self, at: int) -> None:
        if at < self.run_end:
            return
        self.run_end = self._RUN.match(self.text, at, self.stop).end()
        self.dot = self.last = -1
        for m in self._DOT.finditer(self.text, at, self.run_end):
            self.dot = m.start()
        for i in range(self.run_end - 1, at - 1, -1):
            if self._LAST.match(self.text, i):
                self.last = i
                break

    def host(self, at: int) -> int:
        m = self._HEAD.match(self.text, at, self.stop)
        if not m:
            return at
        self._run(at)
        return self.run_end if self.dot > m.end() else at

    def scheme(self, at: int) -> int:
        m = self._SCHEME.match(self.text, at, self.stop)
        if not m:
            return at
        self._run(at)
        return self.last + 1 if self.last > m.end() else at

    def match(self, at: int) -> int:
        return max(self.host(at), self.scheme(at))


class Phones:
    """Telephone numbers of a text: groups of digits, some in brackets, each perhaps with a hyphen or slash before it
    and a blank behind it, then digits; a country code with a plus sign may lead.

    A chain of groups is walked once: it can end in a group of several digits or in a plain one behind another. From
    inside the rest of a chain nothing longer than a plain number begins. Places must not decrease.
    """

    _GROUP = re.compile(rf"({cs.HYPHEN}|/)?(?:([0-9]+)|\([0-9]+\)){_H}?")
    _CODE, _BLANK = re.compile(r"\+[0-9]+"), re.compile(_H)

    def __init__(self, text: str, end: int | None = None):
        self.text, self.stop, self.walked = text, len(text) if end is None else end, -1

    def match(self, at: int) -> int:
        if at < self.walked:
            return at
        p, best, first = at, at, True
        if m := self._CODE.match(self.text, at, self.stop):
            p = at + 2 if m.end() > at + 2 else m.end() + bool(self._BLANK.match(self.text, m.end(), self.stop))
        while m := self._GROUP.match(self.text, p, self.stop):
            a, z = m.span(2)
            if z - a > 1 or (z > a and not first and m.start(1) < 0):
                best = z
            p, first = m.end(), False
        if p > at:
            self.walked = p
        return best


def scan_aids(text: str, stop: int) -> tuple[Mail, Links, Phones]:
    return Mail(text, stop), Links(text, stop), Phones(text, stop)


class Scanner:
    """The tokenizer of one language; any but en, fr and it has no prefixes, suffixes and words of its own."""

    def __init__(self, lang: str):
        rx = re.compile
        own = lambda table: rx(lexicons.variants(table[lang])) if lang in table else None
        self.words = own(lexicons.WORDS)
        self.suffixes = rx(f"(?:{lexicons.variants(lexicons.SUFFIXES[lang])})\\Z") if lang in lexicons.SUFFIXES else None
        prefix = f"(?:{lexicons.variants(lexicons.PREFIXES[lang])})" if lang in lexicons.PREFIXES else None
        self.prefix = rx(f"{prefix}{cs.APOSTROPHE}(?:{_A}|{cs.DOUBLE})") if prefix else None
        self.elided = rx(f"({prefix}){cs.APOSTROPHE}{_L}") if prefix else None
        self.assimilation = rx(ASSIMILATION) if lang == "en" else None
        self.symbol, self.path, self.abbr = rx(SYMBOL), rx(PATH), rx(ABBREVIATION)
        self.numbers, self.unknown = [rx(n) for n in NUMBERS], rx(UNKNOWN)
        self.word, *self.bracketed = [rx(w) for w in WORDS]
        self.blank = rx(f"{cs.BLANK}+")

    def _word(self, text: str, at: int, stop: int) -> int:
        """End of the longest word here; after an elided prefix only the prefix itself can be one."""
        if self.elided and (m := self.elided.match(text, at, stop)):
            return m.end(1)
        end = m.end() if (m := self.word.match(text, at, stop)) else at
        if end == at or "(" in text[end : end + 2]:
            return max([end, *(m.end() for w in self.bracketed if (m := w.match(text, at, stop)))])
        return end

    def _suffix(self, text: str, at: int, end: int) -> int:
        """Where the longest suffix of a word begins, which leaves at least one character; else its end."""
        if not self.suffixes or text[max(at + 1, end - 9) : end].isalpha():  # each has a sign besides letters
            return end
        return min((i for i in range(max(at + 1, end - 9), end) if self.suffixes.match(text, i, end)), default=end)

    def scan(
        self, text: str, at: int = 0, stop: int | None = None, aids: tuple[Mail, Links, Phones] | None = None, stretches: bool = False
    ) -> Iterator[tuple[int, int, str]]:
        """(start, end, type) of each token of ``text[at:stop]``, as if there were no more text behind it.

        aids: those of a scan of the same text that was left before ``at``, so that what it looked up isn't looked up again.
        stretches: plain words and signs in a row come as one, with an empty type; ``parts`` tells their tokens.
        """
        n = len(text) if stop is None else stop
        mail, links, phones = aids or scan_aids(text, n)
        plain = _PLAIN.match
        no_path = -1  # no path that begins with ~ or periods ends before here
        while at < n:
            if stretches and (m := _STRETCH.match(text, at, n)):
                yield *m.span(), ""
                if (at := m.end()) == n:
                    return
            if m := plain(text, at, n):
                kind = m.lastindex
                if kind == 1:
                    yield *m.span(1), "LATIN"
                elif kind == 2:
                    yield *m.span(2), "SYM"
                else:
                    for x in _PART.finditer(text, *m.span(3)):
                        yield *x.span(), _part_type(x[0])
                at = m.end()
                continue
            if m := self.blank.match(text, at, n):
                at = m.end()
                continue
            best, kind, sign = at, "", text[at]
            letter, digit = sign in _ASCII_LETTERS, sign in _DIGITS  # with which many kinds don't begin
            if not (letter or digit):
                if m := self.symbol.match(text, at, n):
                    best, kind = m.end(), "SYM"
                if at >= no_path or sign == "/":
                    if m := self.path.match(text, at, n):
                        if m.end() > best:
                            best, kind = m.end(), "PATH"
                    elif m := _HERE.match(text, at, n):
                        no_path = m.end()
            if not digit:
                if (end := links.match(at)) > best:
                    best, kind = end, "URI"
                if (m := self.abbr.match(text, at, n)) and m.end() > best:
                    best, kind = m.end(), "ABBR"
            if not letter:
                end = max(phones.match(at), *[m.end() if (m := x.match(text, at, n)) else at for x in self.numbers])
                if end > best:
                    best, kind = end, "NUM"
            for name, own in (("WORDS", self.words), ("PREFIX", self.prefix)):
                if own and (m := own.match(text, at, n)) and m.end() > best:
                    best, kind = m.end(), name
            if (end := self._word(text, at, n)) > best:
                best, kind = end, "LATIN"
            if (end := mail.match(at)) > best:
                best, kind = end, "EMAIL"
            if not (letter or digit) and (m := self.unknown.match(text, at, n)) and m.end() > best:
                best, kind = m.end(), "UNK"
            if not letter and self.assimilation and (m := self.assimilation.match(text, at, n)) and m.end() > best:
                yield at, at + 2, "LATIN"  # up to the first t; the rest is scanned again
                at += 2
                continue
            if kind == "PREFIX":
                best -= 1  # the character that was looked ahead at
            end = self._suffix(text, at, best) if kind == "LATIN" else best
            yield at, end, "LATIN" if kind == "WORDS" else kind
            if end < best:
                yield end, best, "SUFFIX"
            at = best


def parts(stretch: str) -> list[str]:
    """The tokens of a stretch."""
    return _PART.findall(stretch)


def parts_typed(found: list[str]) -> list[tuple[str, str]]:
    """(str, type) of such tokens."""
    return [(s, _part_type(s)) for s in found]


def _part_type(part: str) -> str:
    return "UNK" if part[0] in "#|" else "SYM" if part[0] in "%&$*!?,;:" else "LATIN"


@cache
def scanner(lang: str | None) -> Scanner:
    return Scanner(lang if lang in ("en", "fr", "it") else "generic")


def tokenize(text: str, lang: str | None) -> list[tuple[str, int, int, str]]:
    """(str, len, offset, type) of each token; a leading byte order mark is skipped and counted."""
    start = 1 if text.startswith(BOM) else 0
    body = text[start:] if start else text
    found = scanner(lang).scan(body)
    return with_bytes(body, found, 3 * start)


def with_bytes(text: str, spans, offset: int = 0) -> list[tuple[str, int, int, str]]:
    """Spans in characters as text with lengths and offsets in bytes."""
    return list(in_bytes(text, spans, 0, offset))


def in_bytes(text: str, spans, at: int, offset: int) -> Iterator[tuple[str, int, int, str]]:
    """The same one by one, for spans behind the character ``at``, whose byte offset is ``offset``."""
    if text.isascii():
        for a, z, t in spans:
            yield text[a:z], z - a, offset - at + a, t
        return
    for a, z, t in spans:
        if a > at:
            offset += _size(text[at:a])
        found = text[a:z]
        size = _size(found)
        yield found, size, offset, t
        offset, at = offset + size, z


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def typed(text: str, lang: str | None) -> Iterator[tuple[str, str]]:
    """(str, type) of each token: the same without lengths and offsets."""
    body = text.removeprefix(BOM)
    return ((body[a:z], t) for a, z, t in scanner(lang).scan(body))
