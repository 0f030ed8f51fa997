"""Character classes as regular-expression text for Python's ``re``."""

from __future__ import annotations

import unicodedata


def span(text: str) -> str:
    """Ranges of hexadecimal code points as the inside of a character class."""
    parts = []
    for r in text.split():
        a, _, z = r.partition("-")
        parts.append(f"\\U{int(a, 16):08x}" + (f"-\\U{int(z, 16):08x}" if z else ""))
    return "".join(parts)


def points(text: str) -> set[int]:
    """The code points of ranges of hexadecimal numbers."""
    out: set[int] = set()
    for r in text.split():
        a, _, z = r.partition("-")
        out.update(range(int(a, 16), int(z or a, 16) + 1))
    return out


def ranges(found: set[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(found):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}" + (f"-\\U{z:08x}" if z > a else "") for a, z in out)


# Letters of the Latin script as of Unicode 8.
LATIN_RANGES = """
0041-005A 0061-007A 00AA 00BA 00C0-00D6 00D8-00F6 00F8-02B8 02E0-02E4 1D00-1D25 1D2C-1D5C
1D62-1D65 1D6B-1D77 1D79-1DBE 1E00-1EFF 2071 207F 2090-209C 212A-212B 2132 214E 2160-2188
2C60-2C7F A722-A787 A78B-A7AD A7B0-A7B7 A7F7-A7FF AB30-AB5A AB5C-AB64 FB00-FB06 FF21-FF3A FF41-FF5A
"""
# Those of them that are neither upper nor lower case.
UNCASED_RANGES = "01BB 01C0-01C3 01C5 01C8 01CB 01F2 0294 2180-2182 2185-2188 A78F A7F7 A7FB-A7FF"

_latin, _uncased = points(LATIN_RANGES), points(UNCASED_RANGES)
# Roman numeral signs are upper case without being letters that unicodedata calls so.
_upper = {c for c in _latin - _uncased if chr(c).isupper()}
_lower = _latin - _uncased - _upper
UPPER_POINTS, LOWER_POINTS = _upper, _lower

MARK = "[̀-ͯ]"
RAW = f"[{ranges(_latin)}]"
LETTER = f"(?:{RAW}{MARK}*)"
UPPER = f"(?:[{ranges(_upper)}]{MARK}*)"
LOWER = f"(?:[{ranges(_lower)}]{MARK}*)"
#: One or more Latin letters or digits.
LATIN = f"(?:{RAW}{MARK}*|[0-9])"

NEWLINE = "\r\n\x0b\x0c\x85\u2028\u2029"
HORIZONTAL = " \t\x0b\xa0\u2000-\u200a\u202f\u205f\u200b"
BLANK = f"[{HORIZONTAL}{NEWLINE}]"
NONBLANK = f"[^{HORIZONTAL}{NEWLINE}]"

APOSTROPHE = "['‘’]"
OPEN_SINGLE, CLOSE_SINGLE, SINGLE = "['‘]", "['’]", "['‘’‚]"
OPEN_DOUBLE, CLOSE_DOUBLE = "(?:``|<<|[\"“„«‹])", "(?:''|>>|[\"”»›])"
DOUBLE = f"(?:{OPEN_DOUBLE}|{CLOSE_DOUBLE})"
OPEN_BRACKET, CLOSE_BRACKET = r"[(\[{]", r"[)\]}]"
HYPHEN, MINUS, DASH = "[-‐‑﹣]", "[-﹣−]", "[‒–—﹘⸺⸻]"
PERIODS = ".\u2024﹒．"
PERIOD = f"[{PERIODS}]"
ELLIPSIS = r"(?:\.{2,}|\.(?: \.){2,}|…)"
VOWELS = "aeiouyáéíóúàèìòùäëïöüâêîôûāēīōū"
VOWELS += VOWELS.upper()

#: Default ignorable code points, dropped by normalisation.
IGNORABLE = span("AD 34F 61C 115F-1160 17B4-17B5 180B-180E 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF")


def category_ordinal(char: str) -> str:
    """The general category of a character as one sign: the place in a fixed order, counted from '0'."""
    return _ORDINAL[unicodedata.category(char)]


# The order of general categories that masks use.
CATEGORIES = "Cn Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co".split()
_ORDINAL = {c: chr(48 + i) for i, c in enumerate(CATEGORIES)}
