"""The English stemmer of the Snowball family ("Porter 2"), from its published description.

R1 is what stands behind the first consonant after a vowel, R2 the same within R1.  Words of one or two letters stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
# Stems that follow no rule, words that stay, words that stay once plurals are off, and beginnings whose R1 is what follows.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
WHOLE_BEGINNINGS = ("gener", "commun", "arsen")
# Endings and what they become, in R1 (second and third step), and endings that fall in R2 (fourth).
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _behind(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, endings) -> str:  # noqa: ANN001
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1 = next((len(b) for b in WHOLE_BEGINNINGS if word.startswith(b)), None) or _behind(word, 0)
    r2 = _behind(word, r1)
    word = _plain(word)
    if word in SETTLED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _swap(_swap(word, r1, r2, SECOND), r1, r2, THIRD)
    end = _longest(word, FOURTH)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _plain(word: str) -> str:
    """Without possessives and plurals."""
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    """Without -ed, -ing and their adverbs, the ending mended."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    bare = word[: len(word) - len(end)]
    if end in ("eed", "eedly"):
        return bare + "ee" if len(bare) >= r1 else word
    if not end or not _has_vowel(bare):
        return word
    if bare.endswith(("at", "bl", "iz")):
        return bare + "e"
    if _DOUBLE.search(bare):
        return bare[:-1]
    return bare + "e" if len(bare) <= r1 and _SHORT_END.search(bare) else bare


def _swap(word: str, r1: int, r2: int, table: dict[str, str]) -> str:
    end = _longest(word, table)
    bare = word[: len(word) - len(end)]
    if not end or len(bare) < (r2 if end == "ative" else r1):
        return word
    if (end == "ogi" and not bare.endswith("l")) or (end == "li" and not bare.endswith(tuple("cdeghkmnrt"))):
        return word
    return bare + table[end]
