"""Word lists of the languages, and their spelling variants as regular expressions."""

from __future__ import annotations

import re

from . import charsets as cs

# The languages' prefixes, suffixes and whole words.
PREFIXES = {
    "en": "y",
    "fr": "c d j l m n s t jusqu lorsqu puisqu quoiqu qu",
    "it": """agl alcun all anch buon c cent ch cinquant coll com d dall dell dev dov gliel l n nell nessun ottant prim
        quant quarant quell quest s sant senz sessant settant sott sull trent tutt un vent""",
}
SUFFIXES = {
    "en": "'s 've 're 'd 'm 'em 'll n't",
    "fr": """-t-elle -t-elles -t-il -t-ils -t-on -ce -ci -le -la -les -là -moi -toi -lui -leur -je -tu -il -elle -on
        -nous -vous -ils -elles -en -y""",
}
WORDS = {
    "en": "'til &c",
    "fr": "d'abord d'accord d'après d'autant d'œuvre c'est-à-dire par-ci par-là rendez-vous jusque-là",
    "it": "E' ne'",
}
# Abbreviations of all languages, before their period; case matters.
ABBREVIATIONS = """
A Adj Adm Adv Apr Asst Aug B Bart Biol Bldg Brig Bros C Capt Cell Cf Ch Chem Chs Cmdr Co Col Comdr Con Corp
Cpl D DR Dec Dem Dept Depts Dr Drs E Ed Eds Eg Ens Eq Eqs Etc Ex F Feb Fig Figs G Gen Gov H Hon Hosp I Ie Inc
Ins Insp J Jan Jr Jul Jun K L Lt M MM MR MRS MS Maj Mar Messrs Miss Mlle Mme Mol Mr Mrs Ms Msgr N No Nos Nov O
Oct Op Ord P Pfc Ph Prof Pvt Q R Ref Refs Rep Reps Res Rev Rt S Sec Secs Sen Sens Sep Sept Sfc Sgt Sr St Supt
Surg T U Univ V Viz Vol Vols Vs W X Y Z apr aug cf ch chs dec dept depts ed eds eg eq eqs est et al etc ex feb
fig figs ie jan jr jul jun mar mi no nos nov oct p pp ref refs repr rev sec secs sep sept trans v viz vol vols
vs Éd éd
"""


def variants(words: str) -> str:
    """Alternatives for the words, longest first: either case, any apostrophe or hyphen, ligatures written out."""

    def one(word: str) -> str:
        out = []
        for c in word:
            if c == "'":
                out.append(cs.APOSTROPHE)
            elif c == "-":
                out.append(cs.HYPHEN)
            elif c in "œæ":
                a, b = ("oe" if c == "œ" else "ae")
                out.append(f"(?:[{c}{c.upper()}]|[{a}{a.upper()}][{b}{b.upper()}])")
            elif c.isalpha():
                out.append(f"[{c.lower()}{c.upper()}]")
            else:
                out.append(re.escape(c))
        return "".join(out)

    return "|".join(one(w) for w in sorted(words.split(), key=len, reverse=True))
