"""Text cut off by field limits (problem 1).

Two kinds of evidence are joined.

Lengths: a field limit of L makes the lengths of a source pile up at L.  By window functions
every length of a source gets its discrete hazard, the texts that end right there among those at
least as long; each is tested against the hazard of its neighbours (Poisson tail), and the
Benjamini-Hochberg rule keeps the share of false discoveries of a source down.

Endings: a text is complete if it ends with a sentence or a closing line.  Endings that a look
cannot tell (an abbreviation's point, a number's, a closing quotation, an ellipsis, or letters of a
script without end marks) are judged by how often a sentence ends behind the same words inside
all texts of the collection.

An incomplete ending is a cut: by a field limit at a significant length, else in transfer.  At a
significant length an ending is held to a stricter rate.

Defined cases: null, empty and blank texts are no cuts and have no length; a null source is a
source of its own; repeated rows of one key count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from folioflow.llm import sentences as S

# How closing lines begin or look.
CLOSING_LINE = re.compile(
    r"^\s*(?:(?:--?|–|—|•|\*)\s*[^\W\d_].*"
    r"|By (?:the )?[^.!?]{2,60}"
    r"|(?:Contact|Results?|Copyright|Document|Source|Sources|Editor|Photo|Reporting by|Compiled by|Correction|Note|Distributed by|©|\(c\)|All rights)\b.*"
    r"|[\[(]?(?:END|MORE|CONTINUED|ENDS|30|-30-)[\])]?"
    r"|[#*=_~-]{2,}.*)\s*$"
)
_BRACKETED_ELLIPSIS = re.compile(r"\s*(?:[\[(]\s*(?:\.{2,}|…)\s*[\])]|(?:\.{2,}|…)\s*[\])]|[\[(]\s*(?:more|cont(?:inued|\.)?)\s*[\])])\s*$", re.I)
_ELLIPSIS = re.compile(r"\s*(?:\.{2,}|…)\s*$")
_END_QUOTE = re.compile("([.!?…。！？।]+)([\"”»“’)\\]」』]+)$")
_QUOTED_END = re.compile("[.!?…。！？।][\"”»“](?![\"”»“])")
_POINT = re.compile(r"\.(?=[\s\"”»)])")
_UNSURE = re.compile(r"(?:[^\W\d_]{1,5}|[^\W\d_](?:\.[^\W\d_])+|[$€£¥]?[\d.,:]*\d)\.(?=\s|$|[\"”»)])")
_END_MARK = frozenset(".!?…。！？।॥؟۔")
_THAI = re.compile(f"[{S._THAI}]")
_SUFFIXES = (16, 12, 9, 6, 4)
_ALL_ABBREVIATIONS = S.TITLES | S.MAY_END | S.BEFORE_NUMBER


@lru_cache(maxsize=1 << 16)
def shape(token: str) -> str:
    """A word as the contexts know it: names as X, digits as 9."""
    low = re.sub(r"\d+", "9", token.lower())
    bare = low.rstrip(".")
    if token[:1].isupper() and len(bare) > 3 and bare not in _ALL_ABBREVIATIONS and "." not in bare:
        return "X"
    return low


def contexts(text: str, end: int) -> list[str]:
    """Keys of the words up to text[:end], the longest first."""
    line = max(text.rfind("\n", 0, end), end - 80) + 1
    words = [shape(w) for w in text[max(0, line) : end].split()[-4:]]
    return ["w " + " ".join(words[-n:]) for n in range(len(words), 0, -1)]


def _quote_key(text: str, close: int) -> str | None:
    """Key of the quotation that closes at ``close``: its first words and its end."""
    mark = text[close]
    opener = {'"': '"', "”": "“", "“": "„", "»": "«"}.get(mark, mark)
    opened = text.rfind(opener, 0, close)
    if opened < 0:
        return None
    words = [shape(w) for w in re.findall(r"[^\W_]+", text[opened + 1 : close])[:2]]
    return "q " + " ".join(words) + " " + text[close - 1] + mark


def ending(text: str) -> tuple[str, list[str], int]:
    """(verdict, keys, cut length): 'whole', 'cut', or what decides: 'context', 'quote', 'ellipsis', 'suffix'."""
    body = text.rstrip()
    if body.endswith("�"):
        return "cut", [], len(body.rstrip("�"))
    # these patterns end where the text ends: its last character tells whether to search at all
    m = _BRACKETED_ELLIPSIS.search(body) if body.endswith((")", "]")) else None
    if m:
        return "cut", [], m.start()
    line_at = max(body.rfind(c) for c in S.LINE_MARKS) + 1
    line = body[line_at:]
    if CLOSING_LINE.match(line) and (line_at or len(line) < 80) and not (line_at == 0 and line[:1].isupper() and line[:3] == "By "):
        return "whole", [], len(body)
    _, state = S.cuts(body, S.START, line_at)
    quote, _, depth, _, _ = S.unpack(state)
    if quote or depth:
        return "cut", [], len(body)
    m = _ELLIPSIS.search(body, line_at) if body.endswith(("..", "…")) else None
    if m:
        words = [shape(w) for w in line[: m.start() - line_at].split()[-3:]]
        return "ellipsis", ["e " + " ".join(words)], m.start()
    m = _END_QUOTE.search(body, line_at) if body.endswith(tuple("\"”»“’)]」』")) else None
    if m and any(c in m.group(2) for c in '"”»“'):
        key = _quote_key(body, m.start() + len(m.group(1)))
        return ("quote", [key], len(body)) if key else ("whole", [], len(body))
    last = body.rstrip("\"”»“’)]」』")[-1:]
    if last not in _END_MARK:
        if last and _THAI.match(last):
            return "suffix", [f"s{k} " + line[-k:] for k in _SUFFIXES if len(line) >= k], len(body)
        return "cut", [], len(body)
    if last == "." and body.endswith("."):
        m = _UNSURE.search(body, max(line_at, body.rfind(" ") + 1))
        if m and m.end() == len(body):
            token = m.group()[:-1].lower()
            if token[-1:].isdigit() or token in _ALL_ABBREVIATIONS or len(token) == 1 or "." in token:
                return "context", contexts(body, len(body)), len(body)
    return "whole", [], len(body)


def inside(text: str, keys: Counter) -> None:
    """Adds how often a sentence ends, and how often not, behind every unsure place within the text."""
    body = text.rstrip()
    for m in _POINT.finditer(body):
        point = m.start()
        start = max(body.rfind(" ", max(0, point - 40), point), body.rfind("\n", max(0, point - 40), point)) + 1
        token = body[start:point]
        if point + 1 >= len(body) or (len(token) > 5 and token.isalpha()):
            continue
        token = token.lstrip("(\"“«'").lower()
        if token[-1:].isdigit() or token in _ALL_ABBREVIATIONS or len(token) == 1 or "." in token:
            ends = S._stop_ends(body, point, point + 1)
            for key in contexts(body, point + 1):
                keys[key, ends] += 1
    for m in _QUOTED_END.finditer(body):
        if m.end() < len(body):
            key = _quote_key(body, m.end() - 1)
            if key:
                keys[key, S._quote_ends(body, m.end() - 1, True)] += 1
    if not body.isascii() and _THAI.search(body):
        places = {a for a in S.cuts(body, S.START)[0]}
        for i in range(4, len(body)):
            if _THAI.match(body[i - 1]):
                for k in _SUFFIXES:
                    if i >= k and "\n" not in body[i - k : i]:
                        keys[f"s{k} " + body[i - k : i], i in places] += 1


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Endings (kind 0) and, summed over the batch, what was seen inside the texts (kind 1)."""
    for pdf in batches:
        counts: Counter = Counter()
        rows = []
        for key, source, text in zip(pdf["_key"], pdf["_source"], pdf["_text"]):
            verdict, keys, length = ending(text)
            rows.append((0, key, source, verdict, keys, length, len(text), None, 0, 0))
            inside(text, counts)
        sums: dict[str, list[int]] = {}
        for (key, ends), n in counts.items():
            sums.setdefault(key, [0, 0])[bool(ends)] += n
        rows += [(1, None, None, None, None, None, None, key, n[1], n[0] + n[1]) for key, n in sums.items()]
        yield pd.DataFrame(rows, columns=["kind", "key", "source", "verdict", "keys", "length", "n_chars", "context", "ends", "seen"])


def _log_tail(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """log10 of the chance of n or more events where ``expected`` are expected (Poisson)."""
    out = np.zeros(len(n))
    for i, (k, lam) in enumerate(zip(n, expected)):
        if k <= lam:
            continue
        term = math.exp(max(-700.0, k * math.log(lam) - lam - math.lgamma(k + 1))) if lam > 0 else 0.0
        total, j = 0.0, k
        while term > total * 1e-12 and j < k + 1000:
            total += term
            j += 1
            term *= lam / j
        out[i] = math.log10(total) if total > 0 else -300.0
    return out


@F.pandas_udf(T.DoubleType())
def _tail(n: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series(_log_tail(n.to_numpy(float), expected.to_numpy(float)))


def length_hazards(lengths: DataFrame, neighbours: int = 25, rate: float = 0.01) -> DataFrame:
    """source, length, n, at_risk, hazard, expected, log10_p, limit: every length of every source, and whether it is a limit.

    ``lengths``: source and length of each text.  Windows run over distinct lengths, not over texts.
    """
    n = lengths.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source").orderBy("length")
    risk = n.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    near = by.rangeBetween(-neighbours, neighbours)
    others = F.sum("n").over(near) - F.col("n")
    exposure = (F.sum("at_risk").over(near) - F.col("at_risk")) / F.nullif(F.count(F.lit(1)).over(near) - 1, F.lit(0))
    # near the longest texts hazards rise steeply: there the neighbours' mean number is what is expected at least
    # lengths within reach that no text has count as neighbours with hazard 0; half an event keeps the expectation above zero
    longest = F.max("length").over(Window.partitionBy("source"))
    reach = F.least(F.lit(neighbours), F.col("length")) + F.least(F.lit(neighbours), longest - F.col("length"))
    usual = (others + 0.5) / reach / F.coalesce(exposure, F.col("at_risk"))
    tested = risk.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("expected", F.greatest(usual * F.col("at_risk"), (others + 0.5) / reach)).withColumn("log10_p", _tail(F.col("n").cast("double"), F.col("expected")))
    rank = Window.partitionBy("source").orderBy("log10_p", "length")
    tests = F.count(F.lit(1)).over(Window.partitionBy("source"))
    passed = F.col("log10_p") <= F.log10(F.row_number().over(rank) * rate / tests)
    last = F.max(F.when(passed, F.col("log10_p"))).over(Window.partitionBy("source"))
    return tested.withColumn("limit", F.coalesce(F.col("log10_p") <= last, F.lit(False)) & (F.col("n") >= 3))


def find_cuts(df: DataFrame, key: str = "doc_number", source: str = "source", text: str = "text", usual: float = 0.5, strict: float = 0.9) -> DataFrame:
    """key, source, length, cut, cause ('field_limit', 'transfer' or null) of every text.

    An unsure ending is complete where sentences end behind it at a rate of ``usual`` or more; of ``strict`` at a
    significant length.  Unknown context: numbers, titles and letters are cuts, other abbreviations are not.
    """
    from folioflow.plans.lineage import settle, spread

    src = df.where(F.col(text).rlike(r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]")).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    kind = dict(src.dtypes)["_key"]
    read = settle(spread(src).mapInPandas(_read, f"kind int, key {kind}, source string, verdict string, keys array<string>, length int, n_chars int, context string, ends long, seen long"))
    ends = read.where("kind = 0").select("key", "source", "verdict", "keys", "length", "n_chars").dropDuplicates(["key", "source", "n_chars", "verdict", "length"])
    known = read.where("kind = 1").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    unsure = ends.where("verdict in ('context', 'quote', 'suffix')").select("key", "n_chars", "verdict", F.posexplode("keys").alias("rank", "context"))
    least = F.when(F.col("verdict") == "suffix", 3).otherwise(2)
    rates = unsure.join(known, "context").where(F.col("seen") >= least).withColumn("rate", F.col("ends") / F.col("seen"))
    # words: the longest context known; letters: the highest rate of any suffix of at least six
    order = F.when(F.col("verdict") == "suffix", F.struct(F.when(F.col("context").startswith("s4 "), 1).otherwise(0), -F.col("rate"))).otherwise(F.struct(F.col("rank").alias("col1"), F.lit(0.0).alias("col2")))
    judged = rates.groupBy("key", "n_chars").agg(F.min_by(F.struct("rank", "rate"), order).alias("j"))
    formula = ends.where("verdict = 'ellipsis'").select("key", "n_chars", F.col("keys")[0].alias("e"))
    by_formula = formula.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    all_ellipses = by_formula.agg(F.sum("n")).scalar()
    stock = formula.join(by_formula.where((F.col("n") >= 3) & (F.col("n") >= 0.01 * all_ellipses)), "e").select("key", "n_chars", F.lit(True).alias("stock"))
    limits = length_hazards(ends.select("source", "length")).where("limit").select(F.col("source").alias("_s"), F.col("length").alias("_l"))
    out = ends.join(judged, ["key", "n_chars"], "left").join(stock, ["key", "n_chars"], "left")
    out = out.join(limits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l")), "left")
    at_limit = F.col("_l").isNotNull()
    longest = F.size("keys") - F.col("j.rank")
    number = F.element_at("keys", -1).rlike(r"[0-9]\.$")
    title = F.element_at("keys", -1).rlike(r"^w (mr|mrs|ms|dr|prof|st|no|nr|p|vs|sra|dra|mme|m|[a-z])\.$")
    known_here = F.col("j.rate").isNotNull() & ~(number & (longest < 2))
    need = F.when(at_limit, strict).otherwise(usual)
    cut = (
        F.when(F.col("verdict") == "cut", True)
        .when(F.col("verdict") == "ellipsis", F.col("stock").isNull())
        .when(F.col("verdict").isin("context", "quote"), F.when(known_here, F.col("j.rate") < need).otherwise(F.coalesce(number | title, F.lit(False))))
        .when(F.col("verdict") == "suffix", F.when(F.col("j.rate").isNotNull(), F.col("j.rate") < need * 0.2).otherwise(True))
        .otherwise(False)
    )
    out = out.withColumn("cut", cut)
    cause = F.when(F.col("cut"), F.when(at_limit, F.lit("field_limit")).otherwise(F.lit("transfer")))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "length", "n_chars", "verdict", F.col("j.rate").alias("rate"), "cut", cause.alias("cause"))


def cuts_by_source(cuts: DataFrame, key: str = "doc_number", source: str = "source") -> DataFrame:
    """source, articles, cut, share_cut, at_limits of every source."""
    once = cuts.groupBy(source, key).agg(F.max("cut").alias("cut"), F.max((F.col("cause") == "field_limit") & F.col("cut")).alias("limited"))
    total = F.count(F.lit(1))
    return once.groupBy(source).agg(total.alias("articles"), F.sum(F.col("cut").cast("long")).alias("cut"), (F.sum(F.col("cut").cast("long")) / total).alias("share_cut"), F.sum(F.coalesce(F.col("limited").cast("long"), F.lit(0))).alias("at_limits"))
