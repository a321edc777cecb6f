"""Ordered cleaning rules for article text, as tables of (pattern, replacement), and their rendering.

One table serves Spark and SQL alike.  In patterns ``\\b`` is the edge of an ASCII word; ``\\1`` in
a replacement is the first group.  Order matters: a rule sees what those before it left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

Rules = list[tuple[str, str]]

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BLANK = r"[ \t\n\r\f]"

# Fractions and signs that are written out.
FRACTIONS = {"half": "1/2", "third": "1/3", "two_thirds": "2/3", "quarter": "1/4", "three_quarters": "3/4", "fifth": "1/5"}
SIGNS = {"also": "&", "percent": "%", "plus": r"\+", "equals": "=", "either": "/"}
# Web addresses become words.
ADDRESSES: Rules = [
    (r"www[0-9]{0,3}[.]([a-zA-Z0-9])+[.]([a-z]{2,4})", r"xx\1 xx\2"),
    (r"([a-zA-Z0-9])+[.]([a-zA-Z0-9])+[.]([a-z]{2,4})", r"xx\1 xx\2 xx\3"),
]


def written_out(**words: str) -> Rules:
    """Fractions and signs as words: by the names of FRACTIONS and SIGNS, in their order; ``number`` is for "No. 5"."""
    spelled = [(sign, words[name]) for name, sign in (FRACTIONS | SIGNS).items()]
    return [*spelled, (r"\b([Nn][or])(\. )([0-9]+)\b", words["number"] + r"\3")]


def points(names: dict[str, str], any_case: bool = True) -> Rules:
    """Abbreviations with a point, written out."""
    return [(("(?i)" if any_case else "") + r"\b" + short.replace(".", r"\.") + r"\.", long) for short, long in names.items()]


# What English texts spell short.
MONEY: Rules = [
    (r"([0-9.,]+) ?bn\b", r"\1 billion"), (r"([0-9.,]+) ?mn\b", r"\1 million"), (r"\$([0-9.,]+[0-9])", r"\1 dollar"),
    (r"\bdollar billion\b", "billion dollar"), (r"\bdollar million\b", "million dollar"),
    (r"\bps ?([0-9.,]+[0-9])b\b", r"\1 billion pound sterling"), (r"\bps ?([0-9.,]+[0-9])m\b", r"\1 million pound sterling"), (r"\bps ?([0-9.,]+[0-9])", r"\1 pound sterling"),
]
TIMES: Rules = [
    (r"[0-9]{1,2} ?a\.?m\.?\b", "time_val time_am"), (r"[0-9]{1,2} ?p\.?m\.?\b", "time_val time_pm"),
    (r"[0-9]{1,2}:[0-9]{2} ?a\.?m\.?\b", "time_val time_am"), (r"[0-9]{1,2}:[0-9]{2} ?p\.?m\.?\b", "time_val time_pm"), (r"[0-9]{1,2}:[0-9]{2}", "time_val"),
]
SHORT_FORMS: Rules = [
    (r"(?i)\bit's\b", "it is"), (r"(?i)\bhe's\b", "he is"), (r"(?i)\bshe's\b", "she is"), (r"(?i)\bain't\b", "is not"), (r"(?i)\bisn't\b", "is not"), (r"(?i)\baren't\b", "are not"),
    (r"(?i)\blet's\b", "let us"), (r"(?i)\bwon't\b", "will not"), (r"(?i)\bcan't\b", "can not"), (r"(?i)n't", " not"), (r"(?i)\bcannot\b", "can not"),
    (r"([A-Za-z]+)'d", r"\1 had"), (r"(?i)([a-z]+)'ll", r"\1 will"), (r"(?i)([a-z]+)'m", r"\1 am"), (r"(?i)([a-z]+)'ve", r"\1 have"), (r"(?i)([a-z]+)'re", r"\1 are"),
    (r"(?i)\bbull's eye\b", "bullseye"), (r"(?i)\bno man's land\b", "nomansland"), (r"(?i)\bpandora's box\b", "pandoras box"), (r"(?i)\b([a-z]+)'s\b", r"\1"),
    (r"""(?i)\btoo ?([.,:;)'"\]])""", r"also \1"), (r"(?i)\bun-", "not "),
]
VALENCE: Rules = [
    (r"(?i)-like", " xlike"), (r"(?i), well,", " xwell,"), (r"(?i)[\.]{2,} well", " xwell"), (r"(?i)\bWell,", "xwell,"),
    (r"\bOK\b", "okay"), (r"(?i), okay,", " xokay"), (r"(?i)[\.]{2,} okay", " xokay"), (r"(?i)\bOkay,", "xokay,"),
]
PROVINCES: Rules = points({"Que": "Quebec", "Ont": "Ontario", "Nfld": "Newfoundland", "Alta": "Alberta", "Man": "Manitoba", "Sask": "Saskatchewan"}, False)
STATES: Rules = points({"Ala": "Alabama", "Calif": "California", "Mass": "Massachusetts"}, False)
VERSUS: Rules = points({"vs": "versus"})
ADDRESS: Rules = [
    *points({"St": "St", "Ste": "Ste", "i.e": "that is", "et al": "et alii", "mr": "Mr", "ms": "Ms", "mrs": "Mrs", "prof": "Prof"}),
    (r"(?i)\ba\. ?m\. ", "am "), (r"(?i)\bp\. ?m\.", "pm "), *points({"dr": "Dr", "gen": "gen"}), (r"(?i)\be\. coli\b", "ecoli"),
]
MONTH_NAMES: Rules = points({"Jan": "January", "Feb": "February", "Mar": "March", "Apr": "April", "Jun": "June", "Jul": "July", "Aug": "August", "Sept": "September", "Oct": "October", "Nov": "November", "Dec": "December"}, False)
INCORPORATED: Rules = points({"inc": "incorporated"})
ENGLISH: Rules = [
    *MONEY, *TIMES, *SHORT_FORMS, *VALENCE, *PROVINCES, *STATES, *VERSUS, *ADDRESS, *INCORPORATED, *MONTH_NAMES,
    *written_out(half=" half ", third=" one third ", two_thirds=" two thirds ", quarter=" one fourth ", three_quarters=" three fourths ", fifth=" one fifth ", also=" and ", percent=" percent ", plus=" plus ", equals=" is equal to ", either=" or ", number=" number "),
]
# The same for other languages.
FRENCH: Rules = [
    (r"(?i)\bmr\.? ?", "monsieur "), (r"(?i)\bmme\.? ?", "madame "), (r"(?i)\bmlle\.? ?", "mademoiselle "), (r"(?i)aujourd'hui", "aujourdhui"), (r"(?i)(c|d|j|l|m|qu|r|s|t)'([a-zA-Zàî])", r"\1e \2"),
    *written_out(half=" la moitie ", third=" un tiers ", two_thirds=" deux tiers ", quarter=" un quart ", three_quarters=" trois quarts ", fifth=" vingt pour cent ", also=" et ", percent=" pour cent ", plus=" plus ", equals=" est ", either=" ou ", number=" numero "),
]
GERMAN: Rules = [
    *points({"ca": "circa", "vs": "versus", "St": "Sint"}),
    *written_out(half=" die halfte ", third=" ein drittel ", two_thirds=" zwei drittel ", quarter=" ein viertel ", three_quarters=" drei viertel ", fifth=" ein funftel ", also=" und ", percent=" prozent ", plus=" plus ", equals=" ist ", either=" oder ", number=" nummer "),
]
SPANISH: Rules = [
    *points({"Sr": "Senor ", "Sra": "Senora ", "Srta": "Senorita "}),
    *written_out(half=" un medio ", third=" un tercio ", two_thirds=" dos tercios ", quarter=" un cuarto ", three_quarters=" tres cuartos ", fifth=" un quinto ", also=" y ", percent=" por ciento ", plus=" mas ", equals=" es igual a ", either=" o ", number=" numero "),
]
DUTCH: Rules = [
    (",,", '"'), (r"(?i)\bun-", "niet "), (r"(?i)\b([a-z]+)'s\b", r"\1"),
    *points({"ca": "circa", "vs": "versus", "St": "Sint", "e.d": "en dergelijke", "o.a": "onder anderen", "d.m.v": "door middel van", "d.w.z": "dat wil zeggen", "t.a.v": "ten aanzien van", "m.m.v": "met medewerking van"}),
    *written_out(half=" de helft ", third=" een derde ", two_thirds=" twee derde ", quarter=" een vierde ", three_quarters=" drie vierde ", fifth=" een vijfde ", also=" en ", percent=" procent ", plus=" plus ", equals=" is gelijk aan ", either=" of ", number=" nummer "),
]
DANISH: Rules = [*written_out(half=" 1div2 ", third=" 1div3 ", two_thirds=" 2div3 ", quarter=" 1div4 ", three_quarters=" 3div4 ", fifth=" 1div5 ", also=" og ", percent=" prosent ", plus=" plus ", equals=" er ", either=" eller ", number=" nummer ")]
ITALIAN: Rules = [
    (r"(?i)\bSig\.", "Signore "), (r"(?i)\bSigg\.", "Signori "), (r"\bS\.", "Santo "), (r"\bSS\.", "Santi "),
    (r"(?i)\b(bell|grand|sant|quest|quell|tutt|mezz|molt|cent|quant)'([aeiouyhAEIOUYH][A-Za-z0-9_]*?a\b)", r"\1a \2"), (r"(?i)\b(bell|grand|sant|quest|quell|tutt|mezz|molt|cent|quant)'([aeiouyhAEIOUYH])", r"\1o \2"),
    (r"(?i)\b(buon)'([aeiouyhAEIOUYH])", r"\1a \2"), (r"(?i)\b(fors|dev|diss)'([aeiouyhAEIOUYH])", r"\1e \2"), (r"(?i)l'([aeiouyhAEIOUYH][A-Za-z0-9_]*?a\b)", r"la \1"), (r"(?i)l'([aeiouyhAEIOUYH])", r"lo \1"),
    (r"(?i)un'([aeiouyhAEIOUYH])", r"una \1"), (r"(?i)d'ora", "da ora"), (r"(?i)d'allora", "da allora"), (r"(?i)(d|m|t|v|s)'([aeiouyhAEIOUYH])", r"\1i \2"), (r"(?i)(gl|c)'([eiEI])", r"\1i \2"), (r"(?i)(n)'([aeiouyhAEIOUYH])", r"\1e \2"),
    *written_out(half=" la meta ", third=" un terzo ", two_thirds=" due terzi ", quarter=" un quarto ", three_quarters=" tre quarti ", fifth=" un quinto ", also=" e ", percent=" per cento ", plus=" piu ", equals=" e ", either=" o ", number=" numero "),
]
PACKS = {"english": ENGLISH, "français": FRENCH, "deutsch": GERMAN, "espanol": SPANISH, "nederlands": DUTCH, "dansk": DANISH, "italiano": ITALIAN}

# Punctuation of every language is reduced to points and commas.
MARKS: Rules = [
    (r"(?i)\bba'ath", "baath"), (r"([#*<>@\\^|~])", r" \1 "), (r"( [a-zA-Z])\. ", r"\1 "), ("!", "."), (r"\?", "."), (";", "."), (r"[\.]{2,}", "."),
    ('"', ", "), ("'", ", "), (":", ","), ("--", ","), (" - ", " , "), (r"\[", ", "), (r"\]", " , "), (r"\(", ", "), (r"\)", " , "), (r"\{", ", "), (r"\}", " , "), (r"\.,", ","), ("`", " "),
    (_BLANK + "{2,}", " "), (",( ?,)+", ","), (r"\.( ?\.)+", "."), ("_", " "),
    (r"(\.)([A-Z])(\.) ", r"\1\2 "), *[(r"([A-Z])(\.)([A-Z])", r"\1\3")] * 5, (r"([0-9])(\.)([0-9])", r"\1dot\3"),
    (r"\.", " . "), (",", " , "), (_BLANK + "{2,}", " "), (",( ,)+", ","), (r"\.( \.)+", "."),
]

# The older English chain, which leaves no commas.
SINGLE_LETTER: Rules = [(r"( [a-zA-Z])\. ", r"\1 ")]
ACRONYMS: Rules = [(r"(\.)([A-Z])(\.) ", r"\1\2 "), *[(r"([A-Z])(\.)([A-Z])", r"\1\3")] * 5, (r"([0-9])(\.)([0-9])", r"\1dot\3")]
ENGLISH_NO_COMMAS: Rules = [
    *ADDRESSES, (r"\[ps\]", ""), (r"\[es\]", ""), *MONEY, *TIMES, ("&", " and "), ("%", " percent"), (r"\+", " plus "), ("=", " is equal to "), ("/", " or "), ("I3 or 4", ""),
    (r"([#*<>@\\^|~])", r" \1 "), *SHORT_FORMS, (r"(?i)\bba'ath", "baath"), ("!", "."), (r"\?", "."), (";", "."), (r"[\.]{2,}", "."), (":", ","),
    ('"', ", "), ("'", ", "), ("--", ","), (" - ", ","), (r"\[", ","), (r"\]", ","), (r"\(", ","), (r"\)", ","), (r"\{", ","), (r"\}", ","), (r"\.,", ","), (",( ?,)+", ","), (r"\.( ?\.)+", "."), ("_", " "),
    *VALENCE, (r"\b([Nn][or])(\. )([0-9]+)\b", r"#\3"), *SINGLE_LETTER, *PROVINCES, *ADDRESS, *VERSUS, *INCORPORATED, *MONTH_NAMES, *ACRONYMS, (r"\.", " . "), (",", " "), (" {2,}", " "), (r"\.( \.)+", "."),
]

# Word lists to strip, each with the blank behind it.
STOP_BASIC: Rules = [(r"(?i)\b(a|an|the|and|or|that) ", "")]
STOP_POSSESSIVE: Rules = [(r"(?i)\b(my|your|his|her|its|our|their) ", "")]
NOT_TOGETHER: Rules = [("-", "_"), (r"\bnot ([A-Za-z]+)", r"not_\1")]
STRIP_COMMAS: Rules = [(",", " "), (_BLANK + "{2,}", " ")]
STRIP_POINTS: Rules = [(r"\.", " "), (_BLANK + "{2,}", " ")]
UNWRAP_STARS: Rules = [(r"\*([A-Za-z0-9]+)\*", r"\1")]


def chain(language: str) -> Rules:
    """All rules for a language, in order."""
    return [*ADDRESSES, *PACKS[language], *MARKS]


def clean(text: Column, rules: Rules) -> Column:
    """The text after all rules; null stays null."""
    def one(col: Column, rule: tuple[str, str]) -> Column:
        pattern, to = rule
        plain = to.replace("$", r"\$")
        for i in (1, 2, 3):
            plain = plain.replace(f"\\{i}", f"${i}")
        return F.regexp_replace(col, pattern.replace(r"\b", _EDGE), F.lit(plain))

    return reduce(one, rules, text)


def clean_sql(text: str, rules: Rules) -> str:
    """The same as an SQL expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return reduce(lambda e, r: f"regexp_replace({e}, {quote(r[0])}, {quote(r[1])}, 'g')", rules, text)
