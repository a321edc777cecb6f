"""The stemmer of M. F. Porter, "An algorithm for suffix stripping", Program 14 (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# The suffix tables of the paper's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for every letter; y is a vowel behind a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                w = base + table[suffix] if _measure(base) > 0 else w
                break
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
