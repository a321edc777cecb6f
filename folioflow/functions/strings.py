"""String similarity by definition: distances, ratios, medians and edit scripts, as vectorised functions over columns.

distance counts insertions, deletions and replacements; ratio is 2 * LCS / (sum of lengths).
Any null argument gives null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

SCRIPT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("spos", T.IntegerType()), T.StructField("dpos", T.IntegerType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("spos", T.IntegerType()), T.StructField("dpos", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits (Hyyro 2004)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def hamming_column(a: Column, b: Column) -> Column:
    """Places at which two columns of strings of one length differ; an error where the lengths differ, null for null."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    n = F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0), lambda total, x: total + x)
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("strings of one length are wanted"))).otherwise(n)


def hamming(a: str, b: str) -> int:
    if len(a) != len(b):
        raise ValueError("strings of one length are wanted")
    return sum(x != y for x, y in zip(a, b))


def jaro(a: str, b: str) -> float:
    """Letters of the longer string are matched in turn, each with the earliest free equal letter of the shorter one whose
    place is at most half of the shorter length (rounded up) away; a match out of turn is half a transposition."""
    if not a or not b:
        return float(not a and not b)
    short, long = sorted((a, b), key=len)
    reach = (len(short) + 1) // 2
    turn = [0] * len(short)
    found = 0
    for i, c in enumerate(long):
        for j in range(max(0, i - reach), min(len(short), i + reach + 1)):
            if not turn[j] and short[j] == c:
                found += 1
                turn[j] = found
                break
    if not found:
        return 0.0
    out_of_turn = sum(t != n for n, t in enumerate(filter(None, turn), 1))
    return (found / len(a) + found / len(b) + 1 - out_of_turn / found / 2) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a, b):
        if x != y:
            break
        prefix += 1
    return min(1.0, j + weight * prefix * (1 - j))


def quick_ratio(a: str, b: str) -> float:
    """Upper bound of the ratio by the letters in common, whatever their order."""
    if not a and not b:
        return 1.0
    left, both = Counter(a), 0
    for c in b:
        if left[c] > 0:
            left[c] -= 1
            both += 1
    return 2.0 * both / (len(a) + len(b))


def quick_ratio_bound(a: str, b: str) -> float:
    """Upper bound of the ratio by lengths alone."""
    return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 1.0


def edit_script(a: str, b: str) -> list[tuple[str, int, int]]:
    """A least edit script; going back from the end, it keeps its direction, else prefers keep, replace, insert, delete."""
    n, m = len(a), len(b)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        cost[i][0] = i
    for j in range(m + 1):
        cost[0][j] = j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    ops: list[tuple[str, int, int]] = []
    i, j, last = n, m, ""
    while i or j:
        here = cost[i][j]
        insert, delete = j > 0 and cost[i][j - 1] + 1 == here, i > 0 and cost[i - 1][j] + 1 == here
        keep = i > 0 and j > 0 and a[i - 1] == b[j - 1] and cost[i - 1][j - 1] == here
        change = i > 0 and j > 0 and cost[i - 1][j - 1] + 1 == here
        if last == "insert" and insert:
            pick = "insert"
        elif last == "delete" and delete:
            pick = "delete"
        else:
            pick = "keep" if keep else "replace" if change else "insert" if insert else "delete"
        if pick == "insert":
            j -= 1
        elif pick == "delete":
            i -= 1
        else:
            i, j = i - 1, j - 1
        if pick != "keep":
            ops.append((pick, i, j))
        last = pick
    return ops[::-1]


def apply_script(ops: list, a: str, b: str) -> str:
    out, at = [], 0
    for op, s, d in ops:
        out.append(a[at:s])
        at = s
        if op != "delete":
            out.append(b[d])
        if op != "insert":
            at += 1
    out.append(a[at:])
    return "".join(out)


def inverse(ops: list) -> list[tuple[str, int, int]]:
    turn = {"insert": "delete", "delete": "insert", "replace": "replace"}
    return [(turn[op], d, s) for op, s, d in ops]


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Runs that the edit script keeps, and an empty one at the ends."""
    out, s, d = [], 0, 0
    for op, i, j in [*edit_script(a, b), ("end", len(a), len(b))]:
        if i > s:
            out.append((s, d, i - s))
        s, d = i + (op in ("replace", "delete")), j + (op in ("replace", "insert"))
    return [*out, (len(a), len(b), 0)]


def set_median(strings: list[str], weights: list[float] | None = None) -> str | None:
    """The string of the list with the least weighted sum of distances; the first of equals."""
    weights = weights or [1.0] * len(strings)
    best, least = None, float("inf")
    for s in strings:
        total = 0.0
        for t, w in zip(strings, weights):
            total += w * distance(s, t)
            if total >= least:
                break
        if total < least:
            best, least = s, total
    return best


def quick_median(strings: list[str], weights: list[float] | None = None) -> str:
    """A string of the mean length in which every place holds what the strings stretched over it vote for."""
    weights = weights or [1.0] * len(strings)
    total = sum(weights)
    length = int(sum(w * len(s) for s, w in zip(strings, weights)) / total + 0.499999) if total else 0
    out = []
    for j in range(length):
        votes: dict[str, float] = {}
        for s, w in zip(strings, weights):
            n = len(s)
            if not n:
                continue
            low, high = n / length * j, n / length * (j + 1)
            first, last = int(low), max(int(low), int(-(-high // 1)) - 1)
            for k in range(first, min(last, n - 1) + 1):
                part = min(high, k + 1) - max(low, k)
                votes[s[k]] = votes.get(s[k], 0.0) + w * part
        if votes:
            out.append(max(sorted(votes), key=lambda c: votes[c]))
    return "".join(out)


def sequence_ratio(a: list[str], b: list[str]) -> float:
    """Ratio of two lists of strings, where replacing costs as much as the strings differ."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + 2.0 * (1 - ratio(x, y)))
    return (total - row[-1]) / total


def set_ratio(a: list[str], b: list[str]) -> float:
    """Ratio of two sets of strings under the best assignment of one's strings to the other's."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    cost = [[1 - ratio(x, y) for y in b] for x in a]
    spent = sum(cost[i][j] for i, j in enumerate(assign(cost))) if a else 0.0
    return (total - (len(b) - len(a) + 2 * spent)) / total


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in the cheapest assignment of all rows (shortest augmenting paths); no more rows than columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def column(f: Callable, kind: T.DataType):  # noqa: ANN201
    """A vectorised function of columns from one of plain values."""

    @F.pandas_udf(kind)
    def apply(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*[list(v) if not isinstance(v, (str, int, float)) else v for v in row]) for row in zip(*args, strict=True)], dtype=object)

    return apply


def _row_after(row: list[int], symbol: str, string: str) -> list[int]:
    """The next row of the distance table of a candidate against a string, when the candidate gets one more symbol."""
    out = [row[0] + 1]
    for j, c in enumerate(string):
        out.append(min(row[j] + (c != symbol), row[j + 1] + 1, out[j] + 1))
    return out


def greedy_median(strings: list[str], weights: list[float] | None = None) -> str:
    """A generalized median grown symbol by symbol: each time the symbol after which the strings can still come nearest.

    Of all strings grown on the way, up to twice the longest and one more, the one with the least weighted sum of
    distances is taken; of equal symbols the first in order.
    """
    weights = weights or [1.0] * len(strings)
    rows = [list(range(len(s) + 1)) for s in strings]
    symbols = sorted({c for s in strings for c in s})
    grown, best, least = "", "", sum(w * len(s) for s, w in zip(strings, weights))
    for _ in range(2 * max((len(s) for s in strings), default=0) + 1):
        picked = None
        for symbol in symbols:
            after = [_row_after(r, symbol, s) for r, s in zip(rows, strings)]
            nearest, total = sum(w * min(r) for r, w in zip(after, weights)), sum(w * r[-1] for r, w in zip(after, weights))
            if picked is None or (nearest, total) < picked[:2]:
                picked = (nearest, total, symbol, after)
        if picked is None or picked[0] > least:
            break
        grown += picked[2]
        rows = picked[3]
        if picked[1] < least:
            best, least = grown, picked[1]
    return best


def improve_median(start: str, strings: list[str], weights: list[float] | None = None) -> str:
    """One pass over the places of a string: each is replaced, deleted or gets a symbol before it, where that brings the strings nearest."""
    weights = weights or [1.0] * len(strings)
    symbols = sorted({c for s in strings for c in s})

    def total(x: str) -> float:
        return sum(w * distance(x, s) for s, w in zip(strings, weights))

    at, least = 0, total(start)
    while at <= len(start):
        options = [(start[:at] + c + start[at + 1 :], 1) for c in symbols if at < len(start)] + [(start[:at] + c + start[at:], 1) for c in symbols]
        if at < len(start):
            options.append((start[:at] + start[at + 1 :], 0))
        best, step = min(((x, n) for x, n in options), key=lambda o: total(o[0]), default=(start, 1))
        if total(best) < least:
            start, least = best, total(best)
            at += step
        else:
            at += 1
    return start


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """The edit script as blocks: (kind, from, to, from, to), 'equal' where nothing changes."""
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for op, s, d in [*edit_script(a, b), ("end", len(a), len(b))]:
        if s > i:
            out.append(("equal", i, s, j, d))
        if op == "end":
            break
        i, j = s + (op != "insert"), d + (op != "delete")
        last = out[-1] if out else None
        if last and last[0] == op and last[2] == s and last[4] == d:
            out[-1] = (op, last[1], i, last[3], j)
        else:
            out.append((op, s, i, d, j))
    return out


def subtract(ops: list, done: list) -> list[tuple[str, int, int]]:
    """What is left of a script when some of its operations, in order, have been done: it starts from their result."""
    out, shift, k = [], 0, 0
    for op, s, d in ops:
        if k < len(done) and tuple(done[k]) == (op, s, d):
            shift += {"insert": 1, "delete": -1, "replace": 0}[op]
            k += 1
        else:
            out.append((op, s + shift, d))
    if k < len(done):
        raise ValueError("the second script is not part of the first")
    return out
