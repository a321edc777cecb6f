"""One form for text that looks the same (problem 10).

Ignorable characters are deleted, letters, digits and spaces are brought to their
compatibility form and composed.  What is left are look-alike letters of other scripts: every
word that mixes scripts becomes a lattice with, for each letter, the letters that look like it,
and a Viterbi search finds the path whose characters keep to one script and follow each other
as in the clean words of the collection (character pairs counted over all of them).

The differences a text holds are told by what this did to it: what was deleted, what got another form,
what was composed, and which words a best path had to mend (or could not, so that they still mix).

Defined cases: null stays null, an empty text stays empty; words wholly in one script,
typographic quotes and Chinese punctuation are left as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Letters that look alike, as Latin, Cyrillic and Greek strings in step ("-": none).
LATIN_CYRILLIC = ("AaBCcEeHIiJjKMOoPpSsTXxYyhk", "АаВСсЕеНІіЈјКМОоРрЅѕТХхҮуһк")
LATIN_GREEK = ("ABEZHIKMNOoTXYPvupaiyxkn", "ΑΒΕΖΗΙΚΜΝΟοΤΧΥΡνυραιγχκη")
CYRILLIC_GREEK = ("АВЕНКМОоРТХГПФЛрк", "ΑΒΕΗΚΜΟοΡΤΧΓΠΦΛρκ")

_IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb"
    "\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
)
_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\t\x0b\x0c]")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\W_]+")
_CJK = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC", "KATAKANA-HIRAGANA"))
SWITCH = 12.0
CHANGE = 0.5
FLOOR = -9.0


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """Script of a letter, "" for anything else; Chinese, Japanese and Korean letters are one."""
    if not c.isalpha():
        return ""
    first = U.name(c, "").split(" ")[0]
    if first in ("FULLWIDTH", "HALFWIDTH"):
        first = U.name(U.normalize("NFKC", c)[0], "").split(" ")[0]
    if first in ("MODIFIER", "SUPERSCRIPT", "SUBSCRIPT", "FEMININE", "MASCULINE", "MICRO", "MATHEMATICAL", "DOUBLE-STRUCK", "SCRIPT", "BLACK-LETTER", "OHM", "KELVIN", "ANGSTROM"):
        return ""
    return "CJK" if first in _CJK else first


@lru_cache(maxsize=1 << 16)
def compatible(c: str) -> str:
    """Compatibility form of a letter, digit or space that differs only in width, joining or breaking."""
    kind = U.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") and U.category(c)[0] in "LN" and c not in "ำຳ":
        return U.normalize("NFKC", c)
    return " " if U.category(c) == "Zs" else c


def _alternatives() -> dict[str, str]:
    out: dict[str, set[str]] = {}
    for left, right in (LATIN_CYRILLIC, LATIN_GREEK, CYRILLIC_GREEK):
        for a, b in zip(left, right, strict=True):
            out.setdefault(a, {a}).add(b)
            out.setdefault(b, {b}).add(a)
    return {c: "".join(sorted(x)) for c, x in out.items()}


ALTERNATIVES = _alternatives()


def resolve(word: str, scores: dict[str, float]) -> tuple[str, bool]:
    """The best path through the lattice of look-alikes of a word; and whether the word as it stands is a case: the path
    changes it, or it changes scripts on every path."""
    best: dict[str, tuple[float, int, str]] = {"": (0.0, 0, "")}
    for c in word:
        layer: dict[str, tuple[float, int, str]] = {}
        for x in ALTERNATIVES.get(c, c):
            own = script(x)
            top = (-math.inf, 0, "")
            for prev, (score, turns, so_far) in best.items():
                was = script(prev) if prev else own
                turn = bool(own and was and own != was)
                s = score - SWITCH * turn - (CHANGE if x != c else 0.0)
                s += scores.get((prev + x).lower(), FLOOR) if prev else 0.0
                if s > top[0]:
                    top = (s, turns + turn, so_far + x)
            layer[x] = top
        best = layer
    _, turns, path = max(best.values())
    return path, turns > 0 or path != word


def mixes(word: str) -> bool:
    if word.isascii():
        return False
    return len({s for s in map(script, word) if s}) > 1


_PLAIN, _GONE, _BLANK, _OTHER_FORM, _MARK = range(5)


@lru_cache(maxsize=1 << 16)
def treatment(c: str) -> tuple[int, str, str]:
    """What is done to a character wherever it stands: (kind, what becomes of it, name of the difference or "")."""
    if _IGNORABLE.match(c):
        return _GONE, "", "invisible"
    if _SPACE.match(c):
        return _BLANK, " ", "space"
    to = compatible(c)
    if to != c:
        kind = U.decomposition(c).split(" ")[0]
        wide = kind in ("<wide>", "<narrow>") and c.isalnum()
        joined = "LIGATURE" in U.name(c, "") and kind == "<compat>"
        return _OTHER_FORM, to, "full_width" if wide else "ligature" if joined else ""
    return (_MARK if U.combining(c) or U.category(c) == "Mn" else _PLAIN), c, ""


@lru_cache(maxsize=1 << 14)
def _scripts(c: str) -> str:
    return script(U.normalize("NFC", compatible(c))[0]) if not _IGNORABLE.match(c) else ""


def unified(text: str, scores: dict[str, float] | None = None) -> tuple[str, list[str]]:
    """The one form of a text, and the differences that were found on the way."""
    if text.isascii() and not _SPACE.search(text) and not _IGNORABLE.search(text):
        return text, []
    letters = set(text)
    done = [treatment(c) for c in letters]
    found = {name for _, _, name in done if name}
    if any(kind in (_GONE, _BLANK, _OTHER_FORM) for kind, _, _ in done):
        table = {ord(c): to for c, (kind, to, _) in zip(letters, done) if kind in (_GONE, _BLANK, _OTHER_FORM)}
        text = text.translate(table)
    if any(kind == _MARK for kind, _, _ in done):
        composed = U.normalize("NFC", text)
        if composed != text and any(a.isalpha() and treatment(b)[0] == _MARK and len(U.normalize("NFC", a + b)) == 1 for a, b in zip(text, text[1:])):
            found.add("accent")
        text = composed
    else:
        text = U.normalize("NFC", text)
    if len({x for x in map(_scripts, letters) if x}) > 1:
        table = scores or {}

        def mend(m: re.Match) -> str:
            word = m.group()
            if not mixes(word):
                return word
            path, case = resolve(word, table)
            if case:
                found.add("mixed_script")
            return path

        text = _RUN.sub(mend, text)
    return text, [k for k in KINDS if k in found]


# The differences, in the order in which they are given.
KINDS = ("full_width", "ligature", "accent", "invisible", "space", "mixed_script")


def canonical(text: str, scores: dict[str, float] | None = None) -> str:
    """The one form of a text."""
    return unified(text, scores)[0]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words: Counter[str] = Counter()
        for text in pdf["_text"]:
            words.update(_WORD.findall(text))
        low: Counter[str] = Counter()
        for w, n in words.items():
            low[w.lower()] += n
        pairs: Counter[str] = Counter()
        for w, n in low.items():
            if len(w) > 1 and script(w[0]) in ("LATIN", "CYRILLIC", "GREEK") and not mixes(w):
                for a, b in zip(w, w[1:]):
                    pairs[a + b] += n
        yield pd.DataFrame({"pair": pd.Series(list(pairs), dtype=object), "n": pd.Series(list(pairs.values()), dtype="int64")})


def pair_scores(df: DataFrame, text: str = "text") -> dict[str, float]:
    """Log probability of a letter after another, counted over every word of one script of every text.

    The result is bounded by the square of the alphabets (a few thousand pairs), whatever the size of ``df``.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    counts = {r["pair"]: r["n"] for r in src.mapInPandas(_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator()}
    first: dict[str, int] = {}
    for pair, n in counts.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    return {pair: max(FLOOR, math.log(n / first[pair[0]])) for pair, n in counts.items()}


def unify(df: DataFrame, text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """``df`` with text_norm (the one form) and kinds (the differences found; null for a null text)."""
    table = dict(scores or {})

    @F.pandas_udf("text_norm string, kinds array<string>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else unified(t, table) for t in texts]
        return pd.DataFrame({"text_norm": [r[0] for r in rows], "kinds": [r[1] for r in rows]})

    out = df.withColumn("_unified", apply(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("text_norm", "kinds")], "_unified.text_norm", "_unified.kinds")
