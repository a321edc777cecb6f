"""Mixing sources to target weights (problem 9).

Documents are aggregated by membership pattern (the set of sources that hold them).  The
patterns, a handful of rows, and the sources' quotas form a network: start -> pattern, one arc
that opens by one repetition of the pattern's documents at a time, each dearer than the one before; pattern ->
source, as far as the source allows repetition; source -> end, its quota.  A min-cost flow
fills the quotas with as little repetition as possible.  The flow of a pattern is then laid out
on a line of laps over its documents in seeded order: a document at x in [0, 1) gets a copy at
x, x + 1, ... for the source whose stretch of the line holds that place.

Defined cases: documents without a source or without size are in no pattern but their size
counts in the total; a source without documents or with a null target gets none; sources
without a target are not drawn from.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this tokenizer.
TOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
EPSILON = 1e-6


def count_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``df`` with n_tokens, the length of ``text`` in tokens of the public tokenizer at ``path``; null for null."""

    with open(path, "rb") as f:
        vocabulary = f.read()  # sent along: executors need no such file

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return df.withColumn("n_tokens", tokens(F.col(text)))


class Network:
    """A flow network whose flow grows to a maximum by blocking flows over shortest levels."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def arc(self, a: int, b: int, room: float) -> int:
        for x, y, r in ((a, b, room), (b, a, 0.0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, start: int) -> list[int]:
        level = [-1] * len(self.out)
        level[start], queue = 0, deque([start])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > EPSILON and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def fill(self, start: int, end: int) -> None:
        """As much as possible on top of what flows already."""
        while (level := self.levels(start))[end] >= 0:
            turn = [0] * len(self.out)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    path, x = [], start
                    continue
                while turn[x] < len(self.out[x]):
                    e = self.out[x][turn[x]]
                    if self.room[e] > EPSILON and level[self.to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                else:
                    if x == start:
                        break
                    level[x] = -1
                    x = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                x = self.to[e]


def allot(patterns: dict[tuple[str, ...], float], quotas: dict[str, float], repeats: dict[str, int]) -> tuple[dict[tuple[tuple[str, ...], str], float], dict[str, float]]:
    """Flow of every (pattern, source), and what is missing of every source's quota.

    Each repetition of a pattern's documents costs more than the one before, and nothing else costs anything.  So the flow of
    least cost is found lap by lap: the room of one more repetition is opened for all patterns, and the flow is filled up
    before the next, dearer one (what patterns can take together is a polymatroid, on which this greedy order is exact).
    """
    sources, kinds = sorted(quotas), sorted(patterns)
    place = {s: 2 + i for i, s in enumerate(sources)}
    net = Network(2 + len(sources) + len(kinds))
    arcs, ends = {}, {s: net.arc(place[s], 1, quotas[s]) for s in sources}
    taken = {}
    for k, pattern in enumerate(kinds):
        node = 2 + len(sources) + k
        taken[pattern] = net.arc(0, node, 0.0)
        for s in pattern:
            if s in place and repeats[s] > 0:
                arcs[pattern, s] = net.arc(node, place[s], patterns[pattern] * repeats[s])
    most = {p: max((repeats[s] for s in p if s in place), default=0) for p in kinds}
    for lap in range(max(most.values(), default=0)):
        for p in kinds:
            if most[p] > lap:
                net.room[taken[p]] += patterns[p]
        net.fill(0, 1)
    flow = {key: net.room[e ^ 1] for key, e in arcs.items() if net.room[e ^ 1] > EPSILON}
    return flow, {s: net.room[e] if net.room[e] > EPSILON else 0.0 for s, e in ends.items()}


def pattern_name(members: Column) -> Column:
    return F.coalesce(F.concat_ws("\x1f", F.array_sort(members)), F.lit("")).alias("p")


def plan_mixture(docs: DataFrame, targets: DataFrame, members: str, size: str, total: float | None = None) -> tuple[dict, dict, dict, float]:
    """(flow by pattern and source, missing by source, quota by source, total size); ``members`` holds each row's sources.

    Only patterns of sources with a target are gathered on the driver: at most 2 to the power of their number.
    """
    rows = targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats")).collect()
    wanted = F.array(*[F.lit(r["source"]) for r in rows]).cast("array<string>")
    sums = docs.groupBy(pattern_name(F.array_intersect(members, wanted))).agg(F.sum(size).alias("n")).collect()
    everything = float(sum(r["n"] or 0 for r in sums)) if total is None else float(total)
    patterns = {tuple(r["p"].split("\x1f")): float(r["n"]) for r in sums if r["p"] and r["n"]}
    quotas = {r["source"]: r["share"] * everything for r in rows}
    flow, missing = allot(patterns, quotas, {r["source"]: int(r["repeats"]) for r in rows})
    return flow, missing, quotas, everything


def unmet_targets(docs: DataFrame, targets: DataFrame, size: str = "n_chars") -> DataFrame:
    """source, quota, missing of every target that even the most repetition leaves unmet; each document belongs to its own source."""
    flow, missing, quotas, _ = plan_mixture(docs.select(F.array_compact(F.array("source")).alias("m"), F.col(size).alias("n")), targets, "m", "n")
    rows = [(s, quotas[s], missing[s]) for s in sorted(quotas) if missing[s] > 0]
    return docs.sparkSession.createDataFrame(rows, "source string, quota double, missing double")


def memberships(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row a distinct text: doc_id (the least), members (the sources that hold it) and n_tokens."""
    return docs.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_h")).agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set(source)).alias("members"), F.max("n_tokens").alias("n_tokens"))


def draw(texts: DataFrame, targets: DataFrame, seed: int = 1, total: float | None = None) -> DataFrame:
    """doc_id, source, copies, n_tokens: what to take of every distinct text, on account of which source."""
    flow, _, quotas, _ = plan_mixture(texts, targets, "members", "n_tokens", total)
    spark = texts.sparkSession
    sizes: dict[str, float] = {}
    stretches = []
    keyed = texts.where(F.col("n_tokens") > 0).withColumn("p", pattern_name(F.array_intersect("members", F.array(*[F.lit(s) for s in sorted(quotas)]).cast("array<string>")))).withColumn("u", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("u", F.lit(BUCKETS)).cast("int"))
    for (pattern, source), amount in sorted(flow.items()):
        p = "\x1f".join(pattern)
        stretches.append((p, source, sizes.get(p, 0.0), sizes.get(p, 0.0) + amount))
        sizes[p] = sizes.get(p, 0.0) + amount
    lines = spark.createDataFrame(stretches, "p string, source string, low double, high double")
    # the place of a document: buckets before its own (a bounded table), then documents before it in its bucket
    buckets = keyed.groupBy("p", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = buckets.select("p", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("p")).alias("lap"))
    inside = Window.partitionBy("p", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["p", "bucket"])
    at = F.col("before") + F.col("inside")
    # copies whose start lies in [low, high): laps k with low <= at + k * lap < high
    copies = F.ceil((F.col("high") - at) / F.col("lap")) - F.greatest(F.lit(0), F.ceil((F.col("low") - at) / F.col("lap")))
    out = placed.join(lines, "p").withColumn("copies", copies.cast("int")).where(F.col("copies") > 0)
    return out.select("doc_id", "source", "copies", "n_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_tokens drawn, actual_share of the drawn mixture."""
    got = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    everything = got.agg(F.sum("n_tokens").alias("n")).scalar()
    out = targets.select("source", "target_share").join(got, "source", "left")
    return out.select("source", "target_share", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("n_tokens", F.lit(0)) / everything).alias("actual_share"))
