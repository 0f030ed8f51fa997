"""Extended grapheme clusters by the rules of Unicode 9."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from ..functions.charsets import points, ranges
from .tokens import BOM, with_bytes

# Break classes of Unicode 9. Marks follow from the general category, less what was assigned or changed
# later, plus what belongs to the class besides.
CONTROL = "0000-0009 000B-000C 000E-001F 007F-009F 00AD 061C 180E 200B 200E-200F 2028-202E 2060-206F FEFF FFF0-FFFB 1BCA0-1BCA3 1D173-1D17A E0000-E001F E0080-E00FF E01F0-E0FFF"
PREPEND = "0600-0605 06DD 070F 08E2 0D4E 110BD 111C2-111C3"
E_BASE = """
261D 26F9 270A-270D 1F385 1F3C3-1F3C4 1F3CA-1F3CB 1F442-1F443 1F446-1F450 1F46E 1F470-1F478 1F47C 1F481-1F483
1F485-1F487 1F4AA 1F575 1F57A 1F590 1F595-1F596 1F645-1F647 1F64B-1F64F 1F6A3 1F6B4-1F6B6 1F6C0 1F918-1F91E
1F926 1F930 1F933-1F939 1F93C-1F93E
"""
EXTEND_BESIDES = "9BE 9D7 B3E B57 BBE BD7 CC2 CD5-CD6 D3E D57 DCF DDF 1734 200C 302E-302F FF9E-FF9F 1133E 11357 114B0 114BD 115AF 1D165 1D16E-1D172 E0020-E007F"
EXTEND_LATER = """
7FD 898-89F 8CA-8D3 9FE AFA-AFF B55 C04 C3C D00 D3B-D3C D81 EBA ECE 180F 1ABF-1ACE 1DF6-1DFA A82C A8FF A9BD
10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 11073-11074 110C2 111C9 111CF 11241 1133B 1145E
1182F-11837 11839-1183A 1193B-1193C 1193E 11943 119D4-119D7 119DA-119DB 119E0 11A01-11A0A 11A33-11A38 11A3B-11A3E
11A47 11A51-11A56 11A59-11A5B 11A8A-11A96 11A98-11A99 11D31-11D36 11D3A 11D3C-11D3D 11D3F-11D45 11D47 11D90-11D91
11D95 11D97 11EF3-11EF4 11F00-11F01 11F36-11F3A 11F40 11F42 13440 13447-13455 16F4F 16FE4 1CF00-1CF2D 1CF30-1CF46
1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
897 1ACF-1ADD 1AE0-1AEB 10D69-10D6D 10EFA-10EFC 113BB-113C0 113CE 113D0 113D2 113E1-113E2 11B60 11B62-11B64 11B66
11F5A 1611E-16129 1612D-1612F 1E5EE-1E5EF 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5
"""
SPACING_BESIDES = "E33 EB3 1CF2-1CF3 A9BD"
SPACING_LATER = """
CF3 102B-102C 1038 1062-1064 1067-106D 1083 1087-108C 108F 109A-109C 1715 1A61 1A63-1A64 1CF7 AA7B AA7D 11145-11146
111CE 1182C-1182E 11838 11930-11935 11937-11938 1193D 11940 11942 119D1-119D3 119DC-119DF 119E4 11A39 11A57-11A58
11A97 11D8A-11D8E 11D93-11D94 11D96 11EF5-11EF6 11F03 11F34-11F35 11F3E-11F3F 11F41 16F7F-16F87 16FF0-16FF1
113B8-113BA 113C2 113C5 113C7-113CA 113CC-113CD 113CF 11B61 11B65 11B67 1612A-1612C
"""


@cache
def break_classes() -> dict[str, set[int]]:
    """The code points of each break class; what is in none of them is an ordinary sign."""
    of = {k: {c for c in range(0x110000) if unicodedata.category(chr(c)) in k} for k in (("Mn", "Me"), ("Mc",))}
    extend = of["Mn", "Me"] - points(EXTEND_LATER) | points(EXTEND_BESIDES)
    spacing = (of["Mc",] - points(SPACING_LATER) | points(SPACING_BESIDES)) - extend
    lv = set(range(0xAC00, 0xD7A4, 28))
    plain = {"Control": CONTROL, "Prepend": PREPEND, "E_Base": E_BASE, "E_Base_GAZ": "1F466-1F469", "E_Modifier": "1F3FB-1F3FF", "Glue_After_Zwj": "2764 1F48B 1F5E8", "Regional_Indicator": "1F1E6-1F1FF", "ZWJ": "200D", "CR": "D", "LF": "A", "L": "1100-115F A960-A97C", "V": "1160-11A7 D7B0-D7C6", "T": "11A8-11FF D7CB-D7FB"}
    return {k: points(v) for k, v in plain.items()} | {"Extend": extend, "SpacingMark": spacing, "LV": lv, "LVT": set(range(0xAC00, 0xD7A4)) - lv}


@cache
def pattern() -> re.Pattern:
    """One cluster; its alternatives are ordered so that the first that matches is the longest."""
    own = break_classes()
    cls = {k: f"[{ranges(v)}]" for k, v in own.items()}
    ext, after = cls["Extend"], f"[{ranges(own['Extend'] | own['SpacingMark'] | own['ZWJ'])}]"
    hangul = f"{cls['L']}*(?:{cls['V']}+|{cls['LV']}{cls['V']}*|{cls['LVT']}){cls['T']}*|{cls['L']}+|{cls['T']}+"
    people, tone, joiner = cls["E_Base_GAZ"], cls["E_Modifier"], cls["ZWJ"]
    emoji = f"(?:{cls['E_Base']}|{people}){ext}*{tone}|{joiner}{people}{ext}*{tone}|{joiner}(?:{cls['Glue_After_Zwj']}|{people})"
    control = cls["Control"][1:-1]
    core = f"(?:{hangul}|{emoji}|{cls['Regional_Indicator']}{{2}}|[^\r\n{control}])"
    return re.compile(f"\r\n|{cls['Prepend']}*{core}{after}*|[\r\n{control}]")


def graphemes(text: str) -> list[tuple[str, int, int, str]]:
    """(str, len, offset, type) of each cluster, the type always UNK; a leading byte order mark is skipped and counted."""
    start = 1 if text.startswith(BOM) else 0
    body = text[start:]
    return with_bytes(body, ((m.start(), m.end(), "UNK") for m in pattern().finditer(body)), 3 * start)


def count(text: str) -> int:
    """The number of clusters."""
    return sum(1 for _ in pattern().finditer(text, 1 if text.startswith(BOM) else 0))
