"""Articles of one day that are nearly the same, and articles delivered again in one file.

By day: an article is a duplicate of those kept before it on its day if its first 300 characters are
similar to some kept text's (ratio above 0.9 over the article's length) and its title's first 60 to
some kept title's (above 0.8).  An article without text compares its title as a text; an earnings
notice is a duplicate only of an equal title.  The kept ones depend on the order, so that the rule is
a scan, but only a few articles of a day have anything similar before them:

* equal heads share one fate, and all but the first are duplicates;
* pairs of one day are compared in cells of blocks of at most ``BLOCK`` articles, where bounds on
  lengths and on shared pairs of letters leave few for the ratio;
* an article with no similar text before it is kept; the scan is over the others and their links.

Defined cases: rows without a date or key are in no day and come out as no duplicates; a null text or
title is empty; the rows of one key are parts of one article and share the fate of the first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioflow.functions.strings import ratio

# How much of a text and a title is compared, the ratios above which they are similar, and what marks an earnings notice.
TEXT_HEAD, TITLE_HEAD = 300, 60
TEXT_RATIO, TITLE_RATIO = 0.9, 0.8
EARNINGS = "reports earnings for Qtr"
BLOCK = 1000
_BINS = 512


def _letters(texts: list[str]) -> np.ndarray:
    """Counts of pairs of letters in bins, one row a text."""
    out = np.zeros((len(texts), _BINS), dtype=np.int16)
    for i, t in enumerate(texts):
        if len(t) > 1:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            out[i] = np.bincount(((codes[:-1] * 31 + codes[1:]) * 0x9E3779B1 >> 7) % _BINS, minlength=_BINS)
    return out


def _similar(a: str, b: str, least: float) -> bool:
    total = len(a) + len(b)
    return 2 * min(len(a), len(b)) > least * total and ratio(a, b) > least if total else True


def _may_be(x: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which of the others may have a ratio above ``least``: of a common sequence of L letters, every letter left out on one
    side breaks two pairs of it, and on the other side one."""
    common = least * (n + sizes) / 2
    enough = np.minimum(n, sizes) > common - 1e-9
    shared = np.minimum(x, others).sum(axis=1)
    return enough & (shared >= n - 1 - 2 * (n - common) - (sizes - common))


def matches(title: str, text: str, other_title: str, other_text: str) -> tuple[bool, bool]:
    """(text, title) similar to an earlier article's."""
    head, name = text[:TEXT_HEAD], title[:TITLE_HEAD]
    if not head:
        same = _similar(name, other_title[: len(name)], TEXT_RATIO)
        return same, same
    if EARNINGS in title:
        same = name == other_title[: len(name)]
        return same, same
    return _similar(head, other_text[: len(head)], TEXT_RATIO), _similar(name, other_title[: len(name)], TITLE_RATIO)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from every article to those before it: text and title similar, pairs of the cell's two blocks only."""
    pdf = pdf.sort_values("key", ignore_index=True)
    low, high = pdf["x"].iat[0], pdf["y"].iat[0]
    titles, texts, blocks = pdf["title"].tolist(), pdf["text"].tolist(), pdf["b"].to_numpy()
    rows = []

    def compare(j: int, before: np.ndarray) -> None:
        for i in before.tolist():
            by_text, by_title = matches(titles[j], texts[j], titles[i], texts[i])
            if by_text:
                rows.append((pdf["key"].iat[j], pdf["key"].iat[i], by_title))

    def earlier(j: int) -> np.ndarray:
        before = np.arange(j)
        return before if low == high else before[blocks[:j] != blocks[j]]

    by_length: dict[int, list[int]] = {}
    for j in range(1, len(pdf)):
        if not texts[j] or EARNINGS in titles[j]:
            compare(j, earlier(j))
        else:
            by_length.setdefault(min(TEXT_HEAD, len(texts[j])), []).append(j)
    # articles of one length are compared over as many characters of all: one table of letters at a time
    for n, those in by_length.items():
        heads = [t[:n] for t in texts]
        letters, sizes = _letters(heads), np.array([len(t) for t in heads])
        for j in those:
            before = earlier(j)
            compare(j, before[_may_be(letters[j], n, letters[before], sizes[before], TEXT_RATIO)])
    return pd.DataFrame([(pdf["day"].iat[0], *r) for r in rows], columns=["day", "key", "before", "title"])


def _titles(pdf: pd.DataFrame) -> pd.DataFrame:
    """(suspect, before) with similar titles, where one of the cell's blocks holds suspects."""
    pdf = pdf.sort_values("key", ignore_index=True)
    low, high = pdf["x"].iat[0], pdf["y"].iat[0]
    titles, blocks, suspect = pdf["title"].tolist(), pdf["b"].to_numpy(), pdf["suspect"].to_numpy()
    rows, plain = [], []
    for j in np.flatnonzero(suspect).tolist():
        done = False
        for i in range(j):
            if (low != high and blocks[i] == blocks[j]) or (not suspect[i] and done):
                continue
            name = titles[j][:TITLE_HEAD]
            if _similar(name, titles[i][: len(name)], TITLE_RATIO):
                if suspect[i]:
                    rows.append((j, i))
                else:
                    done = True
        if done:
            plain.append(j)
    keys = pdf["key"].tolist()
    pairs = [(keys[j], keys[i]) for j, i in rows] + [(keys[j], None) for j in plain]
    return pd.DataFrame([(pdf["day"].iat[0], *p) for p in pairs], columns=["day", "key", "before"], dtype=object)


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The greedy scan over the suspects of one day; those without a suspect among their links are kept for sure."""
    pdf = pdf.sort_values("key")
    suspects = set(pdf["key"])
    dropped: set = set()
    for key, texts, titles, any_title in zip(pdf["key"], pdf["texts"], pdf["titles"], pdf["any_title"]):
        kept = lambda links: any(k not in dropped for k in (links if links is not None else []))
        if kept(texts) and (any_title or kept(titles)):
            dropped.add(key)
    return pd.DataFrame([(pdf["day"].iloc[0], k) for k in sorted(suspects & dropped)], columns=["day", "key"])


def duplicates_of_day(df: DataFrame, key: str, day: str, title: str, text: str) -> DataFrame:
    """key, duplicate of every key of ``df``; ``key`` gives the order within a day."""
    from folioflow.plans.lineage import settle

    kind = dict(df.dtypes)[key]
    src = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(day).cast("string").alias("day"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"))
    # the first part of an article; a text is compared by its first characters, and compares as many of those before it
    one = src.groupBy("key").agg(F.min(F.struct("day", "title", F.substring("text", 1, TEXT_HEAD).alias("text"))).alias("r")).select("key", "r.*")
    dated = one.where("day is not null")
    first = dated.groupBy("day", "title", "text").agg(F.min("key").alias("key"))
    sizes = first.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = settle(first.join(sizes, "day").withColumn("b", F.pmod(F.xxhash64("key"), "blocks").cast("int")))

    def cells(rows: DataFrame) -> DataFrame:
        other = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return other.select("*", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).groupBy("day", "x", "y")

    links = settle(cells(dealt).applyInPandas(_cell, f"day string, key {kind}, before {kind}, title boolean"))
    suspects = links.select("day", "key").distinct()
    # only days with suspects compare titles
    flagged = dealt.join(suspects.select("day").distinct(), "day", "left_semi").join(suspects.withColumn("suspect", F.lit(True)), ["day", "key"], "left").fillna(False, ["suspect"])
    named = cells(flagged).applyInPandas(_titles, f"day string, key {kind}, before {kind}")
    by_text = links.groupBy("day", "key").agg(F.collect_set("before").alias("texts"))
    by_title = named.groupBy("day", "key").agg(F.collect_set("before").alias("titles"), F.max(F.col("before").isNull()).alias("any_title"))
    special = links.groupBy("day", "key").agg(F.max("title").alias("own"))
    state = by_text.join(by_title, ["day", "key"], "left").join(special, ["day", "key"])
    state = state.select("day", "key", "texts", "titles", F.coalesce("any_title", F.lit(False)).alias("any_title"))
    dropped = state.groupBy("day").applyInPandas(_scan, f"day string, key {kind}")
    # later copies of a head are duplicates whatever became of the first
    late = dated.join(first.select("day", "title", "text", F.col("key").alias("first")), ["day", "title", "text"]).where("key > first").select("key")
    gone = dropped.select("key").unionByName(late).distinct().withColumn("duplicate", F.lit(True))
    return one.select("key").join(gone, "key", "left").select(F.col("key").alias(key), F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def delivered_again(df: DataFrame, path: str, day: str, seq: str, title: str, text: str, head: int = 200) -> DataFrame:
    """``df`` with duplicate: whether an article before it (by ``seq``) in the same file and of the same day has the same first
    ``head`` characters, or the same first 50 of a title of more than 32, or whether the day's first article in the file holds
    those characters anywhere.  What is a duplicate counts for those behind it, too.  An empty text is no duplicate by text.
    """
    out = df.withColumn("_head", F.substring(F.coalesce(text, F.lit("")), 1, head)).withColumn("_name", F.when(F.length(title) > 32, F.substring(title, 1, 50)))
    files = [path, day]
    heads = out.where("_head <> ''").groupBy(*files, "_head").agg(F.min(seq).alias("_first_head"))
    names = out.where("_name is not null").groupBy(*files, "_name").agg(F.min(seq).alias("_first_name"))
    firsts = out.groupBy(*files).agg(F.min(F.struct(F.col(seq), F.coalesce(text, F.lit("")).alias("t"))).alias("_f"))
    out = _null_safe(_null_safe(_null_safe(out, heads, [*files, "_head"]), names, [*files, "_name"]), firsts, files)
    held = F.contains(F.col("_f.t"), F.col("_head")) & (F.col("_head") != "") & (F.col(seq) > F.col(f"_f.{seq}"))
    late = (F.col(seq) > F.col("_first_head")) | (F.col(seq) > F.col("_first_name"))
    dated = F.col(day).isNotNull()
    return out.withColumn("duplicate", F.coalesce(dated & (F.coalesce(late, F.lit(False)) | (F.col(seq) > F.col("_first_name")) | held), F.lit(False))).drop("_head", "_name", "_first_head", "_first_name", "_f")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_r_{i}"]) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, "left").drop(*[f"_r_{i}" for i in range(len(keys))])


def bound_holds(a: str, b: str, least: float = TEXT_RATIO) -> bool:
    """Whether the bound lets a pair pass (for tests)."""
    x = _letters([a, b])
    return bool(_may_be(x[0], len(a), x[1:], np.array([len(b)]), least)[0]) or not math.isfinite(least)
