"""Small fixed texts with what segmentation makes of them: the language rules that the large tables don't reach."""

# Fixed values: (language, text, its tokens with their types).
TOKENS = [
    ('en', "y'all isn't I'm they'd she'll you're he's give 'em", "y'/PREFIX | all/LATIN | is/LATIN | n't/SUFFIX | I/LATIN | 'm/SUFFIX | they/LATIN | 'd/SUFFIX | she/LATIN | 'll/SUFFIX | you/LATIN | 're/SUFFIX | he/LATIN | 's/SUFFIX | give/LATIN | '/SYM | em/LATIN"),
    ('en', "'Twas late; ’tis over, ‘twill pass", "'T/LATIN | was/LATIN | late/LATIN | ;/SYM | ’t/LATIN | is/LATIN | over/LATIN | ,/SYM | ‘t/LATIN | will/LATIN | pass/LATIN"),
    ('en', "'til noon &c.", "'til/LATIN | noon/LATIN | &c/LATIN | ./SYM"),
    ('en', "John's boys' hats", "John/LATIN | 's/SUFFIX | boys/LATIN | '/SYM | hats/LATIN"),
    ('fr', "jusqu'ici lorsqu'on puisqu'elle qu'un s'il t'aime", "jusqu'/PREFIX | ici/LATIN | lorsqu'/PREFIX | on/LATIN | puisqu'/PREFIX | elle/LATIN | qu'/PREFIX | un/LATIN | s'/PREFIX | il/LATIN | t'/PREFIX | aime/LATIN"),
    ('fr', 'Va-t-en donne-le-moi parle-t-elle est-ce viens-tu', 'Va-t/LATIN | -en/SUFFIX | donne-le/LATIN | -moi/SUFFIX | parle/LATIN | -t-elle/SUFFIX | est/LATIN | -ce/SUFFIX | viens/LATIN | -tu/SUFFIX'),
    ('fr', "aujourd'hui D'ACCORD d’après d'autant d'œuvre", "aujourd'hui/LATIN | D'ACCORD/LATIN | d’après/LATIN | d'autant/LATIN | d'œuvre/LATIN"),
    ('fr', "C'est-à-dire par-ci par-là jusque-là", "C'est-à-dire/LATIN | par-ci/LATIN | par-là/LATIN | jusque-là/LATIN"),
    ('fr', 'n\'"ose" m’«aime»', 'n\'/PREFIX | "/SYM | ose/LATIN | "/SYM | m’/PREFIX | «/SYM | aime/LATIN | »/SYM'),
    ('it', "dell'arte un'amica c'è quest'anno vent'anni sull'orlo", "dell'/PREFIX | arte/LATIN | un'/PREFIX | amica/LATIN | c'/PREFIX | è/LATIN | quest'/PREFIX | anno/LATIN | vent'/PREFIX | anni/LATIN | sull'/PREFIX | orlo/LATIN"),
    ('it', "E' vero, ne' prima", "E'/LATIN | vero/LATIN | ,/SYM | ne'/LATIN | prima/LATIN"),
    ('it', "l'uomo e all'alba", "l'/PREFIX | uomo/LATIN | e/LATIN | all'/PREFIX | alba/LATIN"),
    ('de', "der Weg zu Annas Haus isn't qu'un", "der/LATIN | Weg/LATIN | zu/LATIN | Annas/LATIN | Haus/LATIN | isn't/LATIN | qu'un/LATIN"),
    ('es', "l'agua isn't n'importe", "l'agua/LATIN | isn't/LATIN | n'importe/LATIN"),
    ('en', 'see /etc/hosts or ~/notes/a.txt and ../up/x plus /var', 'see/LATIN | /etc/hosts/PATH | or/LATIN | ~/notes/a.txt/PATH | and/LATIN | ../up/x/PATH | plus/LATIN | /var/PATH'),
    ('en', 'go to ftp.site.org/pub or HTTPS://ex.am/p?q=1.', 'go/LATIN | to/LATIN | ftp.site.org/pub/URI | or/LATIN | HTTPS://ex.am/p?q=1/URI | ./SYM'),
    ('en', 'U.K. and e.g. plus i.e. but a.b.c.d', 'U.K/ABBR | ./SYM | and/LATIN | e.g/ABBR | ./SYM | plus/LATIN | i.e/ABBR | ./SYM | but/LATIN | a.b.c.d/ABBR'),
    ('fr', 'J.-P. Dupont', 'J.-P/ABBR | ./SYM | Dupont/LATIN'),
    ('en', "the 1980s, the 1980's and 50's or '60s", "the/LATIN | 1980s/LATIN | ,/SYM | the/LATIN | 1980's/NUM | and/LATIN | 50's/NUM | or/LATIN | '/SYM | 60s/LATIN"),
    ('en', '0xFF 0Xbeef 12:45 9-5 10–12', '0xFF/NUM | 0Xbeef/NUM | 12:45/NUM | 9-5 10/NUM | –/SYM | 12/NUM'),
    ('en', 'call +44 20 7946 0958 or 020-7946/0958', 'call/LATIN | +44 20 7946 0958/NUM | or/LATIN | 020-7946/0958/NUM'),
    ('en', '-3.5e+7 +12 4,200.75 1 000 000', '-3.5e+7/NUM | +12 4,200.75 1 000 000/NUM'),
    ('en', '(re)open un(der)stand call(s) (X)-ray', '(re)open/LATIN | un(der)stand/LATIN | call(s)/LATIN | (X)-ray/LATIN'),
    ('de', '„Wetter“-Karte «Zeit»-Reise', '„/SYM | Wetter/LATIN | “/SYM | -/SYM | Karte/LATIN | «Zeit»-Reise/LATIN'),
    ('en', 'foo_bar €5 ☃snow §3 x²', 'foo/LATIN | _/UNK | bar/LATIN | €/SYM | 5/NUM | ☃/UNK | snow/LATIN | §/UNK | 3/NUM | x²/LATIN'),
    ('en', 'mail to jo.doe@mail.example.org, or a@b', 'mail/LATIN | to/LATIN | jo.doe@mail.example.org/EMAIL | ,/SYM | or/LATIN | a/LATIN | @/UNK | b/LATIN'),
    ('en', 'wait... no. . . yes… really?! oh!!', 'wait/LATIN | .../SYM | no/LATIN | . . ./SYM | yes/LATIN | …/SYM | really/LATIN | ?/SYM | !/SYM | oh/LATIN | !!/SYM'),
    ('en', 'a--b c---d e–f g—h i‐j', 'a/LATIN | --/SYM | b/LATIN | c/LATIN | ---/SYM | d/LATIN | e/LATIN | –/SYM | f/LATIN | g/LATIN | —/SYM | h/LATIN | i‐j/LATIN'),
    ('en', '[x] {y} <z> <<q>> ‹r›', '[/SYM | x/LATIN | ]/SYM | {/SYM | y/LATIN | }/SYM | </SYM | z/LATIN | >/SYM | <</SYM | q/LATIN | >>/SYM | ‹/SYM | r/LATIN | ›/SYM'),
    ('en', 'café naïve Ångström', 'café/LATIN | naïve/LATIN | Ångström/LATIN'),
    ('en', "Q&A salt&pepper ma'am", "Q&A/LATIN | salt&pepper/LATIN | ma'am/LATIN"),
    ('en', "`quote' ``two''", "`/UNK | quote/LATIN | '/SYM | ``/SYM | two/LATIN | ''/SYM"),
    ('en', 'well-known state-of-the-art co-op', 'well-known/LATIN | state-of-the-art/LATIN | co-op/LATIN'),
    ('en', '20°C 5th 3rd 2nd', '20°/LATIN | C/LATIN | 5th/LATIN | 3rd/LATIN | 2nd/LATIN'),
    ('en', '\ufeffstart here', 'start/LATIN | here/LATIN'),
    ('en', 'tab\there\xa0and\u2009there\u200bx', 'tab/LATIN | here/LATIN | and/LATIN | there/LATIN | x/LATIN'),
    ('ru', 'Привет world мир', 'Привет/UNK | world/LATIN | мир/UNK'),
    ('en', '**bold** ==eq== //c++ a+b 50% 3*4 >= <=', '**/SYM | bold/LATIN | **/SYM | ==/SYM | eq/LATIN | ==/SYM | ///SYM | c/LATIN | ++/SYM | a/LATIN | +/SYM | b/LATIN | 50/NUM | %/SYM | 3/NUM | */SYM | 4/NUM | >=/SYM | <=/SYM'),
]

# Fixed values: (language, text, its sentences by rules alone).
SENTENCES = [
    ('en', 'We met Dr. Brown on Jan. 5. It rained.', 'We met Dr. Brown on Jan. 5 . | It rained .'),
    ('en', 'Prices rose 3.5 percent. Why? Nobody knows!', 'Prices rose 3.5 percent . | Why ? | Nobody knows !'),
    ('en', 'He left. "Good," she said. (So it was.) Then they ate.', 'He left . | " Good , " she said . | ( So it was . ) | Then they ate .'),
    ('en', 'Visit www.shop.example.com/a.b?c=1 today. Bye.', 'Visit www.shop.example.com/a.b?c=1 today . | Bye .'),
    ('en', 'First line\nsecond line\n\nNew paragraph', 'First line second line | New paragraph'),
    ('en', 'One\u2029Two', 'One | Two'),
    ('en', 'Write to ann@mail.org. Thanks.', 'Write to ann@mail.org . | Thanks .'),
    ('en', 'Items, e.g. pens, cost little. See fig. 3 below.', 'Items , e.g. pens , cost little . | See fig. 3 below .'),
    ('en', 'It ended... then began. Really?! Yes.', 'It ended ... then began . | Really ? ! | Yes .'),
    ('en', 'The vol. was lost. the rest stayed.', 'The vol. was lost. the rest stayed .'),
    ('en', 'J. R. Ewing came. P. Smith left.', 'J. R . | Ewing came . | P. Smith left .'),
    ('fr', 'Il est venu. « Bonjour ! » dit-il. Puis rien.', 'Il est venu . | « Bonjour ! | » dit -il . | Puis rien .'),
    ('it', "E' tardi. Andiamo.", "E' tardi . | Andiamo ."),
    ('en', 'end of text without mark', 'end of text without mark'),
    ('en', 'Stop.), she said. Go.', 'Stop. ) , she said . | Go .'),
    ('en', 'No. 5 is alive. vs. them', 'No. 5 is alive. vs. them'),
    ('en', '   \n  lead. Next', 'lead . | Next'),
]

# The same by a classifier to which a period ends a sentence where a capital follows.
BY_CLASSIFIER = [
    ('en', 'We met Dr. Brown on Jan. 5. It rained.', 'We met Dr . | Brown on Jan. 5 . | It rained .'),
    ('en', 'Prices rose 3.5 percent. Why? Nobody knows!', 'Prices rose 3.5 percent . | Why ? | Nobody knows !'),
    ('en', 'He left. "Good," she said. (So it was.) Then they ate.', 'He left. " Good , " she said. ( So it was. ) Then they ate .'),
    ('en', 'Visit www.shop.example.com/a.b?c=1 today. Bye.', 'Visit www.shop.example.com/a.b?c=1 today . | Bye .'),
    ('en', 'First line\nsecond line\n\nNew paragraph', 'First line second line | New paragraph'),
    ('en', 'One\u2029Two', 'One | Two'),
    ('en', 'Write to ann@mail.org. Thanks.', 'Write to ann@mail.org . | Thanks .'),
    ('en', 'Items, e.g. pens, cost little. See fig. 3 below.', 'Items , e.g. pens , cost little . | See fig. 3 below .'),
    ('en', 'It ended... then began. Really?! Yes.', 'It ended ... then began . | Really ? | ! | Yes .'),
    ('en', 'The vol. was lost. the rest stayed.', 'The vol. was lost. the rest stayed .'),
    ('en', 'J. R. Ewing came. P. Smith left.', 'J . | R . | Ewing came . | P . | Smith left .'),
    ('fr', 'Il est venu. « Bonjour ! » dit-il. Puis rien.', 'Il est venu. « Bonjour ! | » dit -il . | Puis rien .'),
    ('it', "E' tardi. Andiamo.", "E' tardi . | Andiamo ."),
    ('en', 'end of text without mark', 'end of text without mark'),
    ('en', 'Stop.), she said. Go.', 'Stop. ) , she said . | Go .'),
    ('en', 'No. 5 is alive. vs. them', 'No. 5 is alive. vs. them'),
    ('en', '   \n  lead. Next', 'lead . | Next'),
]

# Fixed values: (text, its grapheme clusters).
GRAPHEMES = [
    ('na\u0308ive', 'n | a\u0308 | i | v | e'),
    ('\u1112\u1161\u11ab\u1100\u1173\u11af', '\u1112\u1161\u11ab | \u1100\u1173\u11af'),
    ('\ud55c\uae00\u11a8', '\ud55c | \uae00\u11a8'),
    ('\U0001f1ee\U0001f1f9\U0001f1eb\U0001f1f7\U0001f1ec', '\U0001f1ee\U0001f1f9 | \U0001f1eb\U0001f1f7 | \U0001f1ec'),
    ('\U0001f44d\U0001f3fd!', '\U0001f44d\U0001f3fd | !'),
    ('\U0001f469\u200d\U0001f467 \U0001f469\u200d\u2764\u200d\U0001f48b\u200d\U0001f468', '\U0001f469\u200d | \U0001f467 |   | \U0001f469\u200d | \u2764\u200d | \U0001f48b\u200d | \U0001f468'),
    ('a\r\nb\n\rc', 'a | \r\n | b | \n | \r | c'),
    ('\u0915\u094d\u0937\u093f\u0924', '\u0915\u094d | \u0937\u093f | \u0924'),
    ('\u0e19\u0e49\u0e33', '\u0e19\u0e49\u0e33'),
    ('\u0601\u0661', '\u0601\u0661'),
    ('x\u200b\u0301y', 'x | \u200b | \u0301 | y'),
    ('e\u0301\u0301\u0301', 'e\u0301\u0301\u0301'),
    ('\u261d\U0001f3fe\U0001f466\u0301\U0001f3fb', '\u261d\U0001f3fe | \U0001f466\u0301\U0001f3fb'),
]

# Fixed values: (class, characters of it, characters that aren't).
CLASSES = [
    ("LETTER", "aZéŁßɐⅫﬁＡ", "1α-ж中"),
    ("UPPER", "AZÉŁⅫ", "aé1ǅʔ"),
    ("LOWER", "azéłßﬁ", "AÉ1ƻ"),
    ("LATIN", "aÉ09ⅷ", "_-α٣"),
    ("MARK", "̀́ͯ", "aͰ˿"),
    ("NEWLINE", "\n\r\x0b\x0c\x85  ", " \ta"),
    ("HORIZONTAL", " \t\xa0   ​", "\n a"),
    ("BLANK", " \t\xa0\n\r ​", "a._"),
    ("NONBLANK", "a._é☃", " \n "),
    ("APOSTROPHE", "'‘’", "\"`‚"),
    ("OPEN_SINGLE", "'‘", "’‚"),
    ("CLOSE_SINGLE", "'’", "‘"),
    ("OPEN_DOUBLE", "\"“„«‹", "”»›'"),
    ("CLOSE_DOUBLE", "\"”»›", "“„«"),
    ("OPEN_BRACKET", "([{", ")<"),
    ("CLOSE_BRACKET", ")]}", "(>"),
    ("HYPHEN", "-‐‑﹣", "–—_"),
    ("MINUS", "-﹣−", "‐–+"),
    ("DASH", "‒–—﹘⸺⸻", "-−~"),
    ("PERIOD", ".․﹒．", ",…:"),
    ("ELLIPSIS", "…", ".·"),
]

# Fixed values: (left token, its type, right token, its type), and their features by language, parted by bars.
FEATURES = [
    ("Nov", "LATIN", "Monday", "LATIN", "LCAP|Nov|LCAP", "Nov|Mond|LCAP/CVC", "122", "LCAP|ov|Mond/122222"),
    ("31", "NUM", "Dezember", "LATIN", "LLOW|31|LCAP", "31|Deze|LCAP/DD", "99", "LLOW|31|Deze/12222222"),
    ("usw", "LATIN", "(", "SYM", "LLOW|usw|SYM", "usw|(|SYM/VCC", "222", "LLOW|sw|(/>"),
    ("", "UNK", "él", "LATIN", "LLOW||LLOW", "|él|LLOW/", "", "LLOW||él/22"),
    ("a.b", "ABBR", "3,5", "NUM", "LLOW|a.b|NUM", "a.b|3,5|NUM/VPC", "2B2", "LLOW|.b|3,5/9B9"),
]

# Lines of a tagged corpus, and (sentence, token, text, tag) of what they hold.
CORPUS = ["The/DT dog/NN barked/VBD ./SYM", "", "I 'm/VB here/RB !/SYM \"/SYM", "a/b/NN 10 000/NUM"]
CORPUS_TOKENS = [
    (0, 0, "The", "DT"), (0, 1, "dog", "NN"), (0, 2, "barked", "VBD"), (0, 3, ".", "SYM"),
    (2, 0, "I 'm", "VB"), (2, 1, "here", "RB"), (2, 2, "!", "SYM"), (2, 3, '"', "SYM"),
    (3, 0, "a/b", "NN"), (3, 1, "10 000", "NUM"),
]

# Text, and the same without ignorable, without unknown code points, in NFKC, folded, and prepared.
TEXTS = [
    ("so\xadft​ ﬁx", "soft ﬁx", "so\xadft​ ﬁx", "so\xadft​ fix", "so\xadft​ fix", "soft ﬁx"),
    ("StraßeＡＢ", "StraßeＡＢ", "StraßeＡＢ", "StraßeAB", "strasseａｂ", "StraßeＡＢ"),
    ("é İ²", "é İ²", "é İ²", "é İ2", "é i̇²", "é İ²"),
]
