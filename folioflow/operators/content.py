"""Filters by what texts hold: phrases, phrases to avoid near them, and the words around a hit.

Texts are taken as words parted by blanks.  A phrase is one or more words; ``*`` in it stands for
the rest of a word, and points and commas at a word's end do not count.  A hit is discarded if a
phrase to avoid stands within ``distance`` words of it (0: overlaps it).  A window is the hit with
``before`` words before and ``after`` words behind it; -1 is the whole text.  Windows that overlap
or touch are one piece of text.  All is done on arrays of words, without leaving the JVM.

Defined cases: a null or empty text has no hit; repeated rows are filtered alike; an empty list of
phrases has no hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

JOINER = " ... "


def words_of(text: Column, caps: bool = False) -> Column:
    """Words parted by blanks; lower case unless capitals matter."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return words if caps else F.transform(words, F.lower)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_patterns(phrase: str, caps: bool = False) -> list[str]:
    """A pattern for each word of a phrase."""
    return ["^" + re.sub(r"\\\*", r"[0-9A-Za-z_-]*", re.escape(w)) + "[.,;:!?]?$" for w in (phrase if caps else phrase.lower()).split()]


def hits(words: Column, phrases: list[str], caps: bool = False) -> Column:
    """(at, n) of every place, from 1, where a phrase of n words stands."""
    found = [F.array().cast("array<struct<at:int,n:int>>"), *[_places(words, word_patterns(p, caps)) for p in phrases]]
    return F.array_distinct(F.flatten(F.array(*found))) if len(found) > 2 else found[-1]


def _places(words: Column, patterns: list[str]) -> Column:
    n = len(patterns)
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    stands = lambda i: reduce(lambda a, b: a & b, [F.rlike(F.get(words, i - 1 + k), F.lit(p)) for k, p in enumerate(patterns)])
    return F.transform(F.filter(places, stands), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n")))


def apart(found: Column, avoid: Column, distance: int) -> Column:
    """The hits with no hit to avoid within ``distance`` words."""
    near = lambda h, a: (a["at"] <= h["at"] + h["n"] - 1 + distance) & (a["at"] + a["n"] - 1 >= h["at"] - distance)
    return F.filter(found, lambda h: ~F.exists(avoid, lambda a: near(h, a)))


def windows(words: Column, found: Column, before: int, after: int, joiner: str = JOINER) -> Column:
    """The words within the windows of the hits, in order; ``joiner`` stands between pieces that do not touch."""
    if before < 0 or after < 0:
        return F.when(F.size(found) > 0, F.array_join(words, " ")).otherwise(F.lit(""))
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.exists(found, lambda h: (i >= h["at"] - before) & (i <= h["at"] + h["n"] - 1 + after)))

    def text(kept: Column) -> Column:
        piece = lambda i, k: F.concat(F.when(F.get(kept, k - 1) == i - 1, " ").otherwise(F.lit(joiner)), F.get(words, i - 1))
        # every piece begins behind a joiner; the first one's is cut off
        return F.substring(F.array_join(F.transform(kept, piece), ""), len(joiner) + 1, 1 << 30)

    return F.when(F.size(found) > 0, bind(kept, text)).otherwise(F.lit(""))


def filter_by_content(
    df: DataFrame, text: str, search: list[str], avoid: list[str] | None = None, distance: int = 0, before: int = -1, after: int = -1,
    joiner: str = JOINER, caps: bool = False, empty: bool = False,
) -> DataFrame:
    """``df`` with filtered (the text within the windows) and n_matches; rows without a match only where ``empty``."""
    def found(w: Column) -> Column:
        kept = lambda h: F.struct(windows(w, h, before, after, joiner).alias("filtered"), F.size(h).alias("n_matches"))
        return bind(apart(hits(w, search, caps), hits(w, avoid or [], caps), distance), kept)

    out = df.withColumn("_r", bind(words_of(F.col(text), caps), found))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("filtered", "n_matches")], "_r.filtered", "_r.n_matches")
    return out if empty else out.where("n_matches > 0")


def filter_by_many(df: DataFrame, text: str, specs: dict[str, tuple[list[str], list[str]]], distance: int = 0, before: int = -1, after: int = -1, joiner: str = " *** ", caps: bool = False) -> DataFrame:
    """Rows with any match: filtered (the pieces of all specifications), n_matches, and the matches of each specification by its name."""
    def found(w: Column) -> Column:
        def one(name: str, search: list[str], avoid: list[str]) -> Column:
            kept = lambda h: F.struct(F.lit(name).alias("name"), windows(w, h, before, after).alias("text"), F.size(h).alias("n"))
            return bind(apart(hits(w, search, caps), hits(w, avoid, caps), distance), kept)

        return F.array(*[one(name, search, avoid) for name, (search, avoid) in specs.items()])

    out = df.withColumn("_r", bind(words_of(F.col(text), caps), found))
    numbers = {name: F.col("_r")[k]["n"] for k, name in enumerate(specs)}
    pieces = F.filter(F.transform("_r", lambda r: r["text"]), lambda t: t != "")
    new = {"filtered": F.array_join(pieces, joiner), "n_matches": reduce(lambda a, b: a + b, numbers.values())} | numbers
    return out.withColumns(new).drop("_r").where("n_matches > 0")


def extract_by_content(df: DataFrame, key: str, text: str, search: list[str], avoid: list[str] | None = None, caps: bool = False) -> DataFrame:
    """All rows of every key of which any row holds a hit that no phrase to avoid overlaps."""
    found = df.where(bind(words_of(F.col(text), caps), lambda w: F.size(apart(hits(w, search, caps), hits(w, avoid or [], caps), 0))) > 0)
    return df.join(found.select(key).distinct(), key, "left_semi")
