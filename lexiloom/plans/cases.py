"""What the documents' texts are changed to where a rule finds nothing in them as they are."""

# What the documents' words are replaced by, so that the languages' rules have something to work on; in
# order, by the language whose rules are asked (Italian ones are put to the Spanish texts).
DERIVED = {
    "en": [(" t", "'s t"), (" a", " isn't a"), (" o", " they'll o"), (" w", " y'w"), (" h", " 'til h"), (" b", " 'Twas b"), (" of ", " /usr/lib/of ~/of ../of/x "), (" e", " www.e.org/x ftp.a.net http://e/ e"), (" s", " 1990's 0xFF 12:30 s"), (" n", ' "n"-s (n)n n(s) ')],
    "fr": [(" une ", " d'accord, "), (" les ", " c'est-à-dire, "), (" la ", " l'"), (" de ", " d'"), (" le ", " qu'"), (" et ", "-t-il "), (" un ", "-moi "), (" des ", " jusqu'")],
    "it": [(" la ", " l'"), (" de ", " dell'"), (" el ", " un'"), (" que ", " c'"), (" y ", " e ne' "), (" los ", " quest'")],
}
# The same for sentences.
DERIVED_SENTENCES = [(". A", '." A'), (". E", ".) (E"), (". I", "... I"), (". T", ".\n\nT"), (" is ", " vol. "), (" la ", " e.g. "), (" und ", " Dr. X. Und "), (" el ", " st. 3.5 el! "), (" to ", " to? "), (" le ", " le., ")]
# The same for grapheme clusters and for normal forms.
DERIVED_CLUSTERS = [("\n", "\r\n"), ("e", "e\u0301\u0301"), ("a", "\u1100\u1161"), ("i", "\U0001f1ee"), ("o", "\U0001f466\U0001f3fd"), ("n", "\u0e19\u0e33")]
DERIVED_FORMS = [("e", "e\u00ad"), ("a", "\u0378a"), ("f", "\ufb01")]
# Letters that become signs of the character classes.
DERIVED_SIGNS = ("abcdefghijklm", "“„‘’‐–…«›﹣−．ⅷ")

#: The character classes that are counted.
CLASSES = (
    "LETTER", "UPPER", "LOWER", "LATIN", "MARK", "NEWLINE", "HORIZONTAL", "BLANK", "NONBLANK", "APOSTROPHE", "OPEN_SINGLE", "CLOSE_SINGLE", "OPEN_DOUBLE",
    "CLOSE_DOUBLE", "OPEN_BRACKET", "CLOSE_BRACKET", "HYPHEN", "MINUS", "DASH", "PERIOD", "ELLIPSIS",
)
# No apostrophe before a digit.
for _lang in ("fr", "it"):
    DERIVED[_lang] += [(f"'{d}", f" {d}") for d in range(10)]
