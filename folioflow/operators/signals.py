"""Sentiment sums, smoothing, spectra, densities and term networks over token positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Blocks of curves that are compared pair by pair: each curve is sent so many times.
BLOCKS = 6
# Widths that the places of one group of a density span.
REACH = 64


def score(tokens: DataFrame, lexicon: DataFrame, feelings: list[str], term: str = "term_str") -> DataFrame:
    """Tokens with one column a feeling, 0 where the lexicon lacks the term."""
    return tokens.join(lexicon, term, "left").fillna(0, subset=feelings)


def sums_by(scored: DataFrame, feelings: list[str], levels: list[str]) -> DataFrame:
    """Sums of the feelings by the levels."""
    return scored.groupBy(*levels).agg(*[F.sum(f).alias(f) for f in feelings])


def sums_of_prefixes(scored: DataFrame, feelings: list[str], levels: list[str]) -> DataFrame:
    """Sums at every prefix of the levels at once, in one pass; ``depth`` levels are given."""
    depth = sum(((F.lit(1) - F.grouping(c)) for c in levels), F.lit(0)).cast("int").alias("depth")
    return scored.rollup(*levels).agg(depth, *[F.sum(f).alias(f) for f in feelings])


def unpivot_sums(scored: DataFrame, feelings: list[str]) -> DataFrame:
    """feeling, total."""
    total = scored.agg(*[F.sum(f).alias(f) for f in feelings])
    return total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in feelings]), F.array(*feelings))).alias("feeling", "total"))


def rolling_triangle(series: DataFrame, order: str, value: str, width: int, group: list[str] | None = None) -> DataFrame:
    """Centred sum and mean under a triangular window of odd width, null where it is not full: two box sums, one upon the other."""
    h = (width + 1) // 2
    w = Window.partitionBy(*(group or [])).orderBy(order)
    box = w.rowsBetween(-(h - 1) // 2 if h % 2 else -(h // 2), (h - 1) // 2 if h % 2 else h // 2 - 1)
    back = w.rowsBetween(-(h - 1) // 2 if h % 2 else -(h // 2 - 1), (h - 1) // 2 if h % 2 else h // 2)
    whole = w.rowsBetween(-(h - 1), h - 1)
    once = series.withColumn("_b", F.sum(value).over(box)).withColumn("_n", F.count(F.lit(1)).over(whole))
    out = once.withColumn("rolling_sum", F.when(F.col("_n") == width, F.sum("_b").over(back) / h))
    return out.withColumn("rolling_mean", F.col("rolling_sum") / h).drop("_b", "_n")


def low_pass(series: DataFrame, place: str, value: str, n: Column | int, keep: int = 5, points: int = 100) -> DataFrame:
    """point, smooth: the ``keep`` lowest cosine components of a series (places 0..n-1), drawn at ``points`` places."""
    spread = series.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(keep - 1))))
    spectrum = spread.groupBy("k").agg((2 * F.sum(F.col(value) * F.cos(math.pi * F.col("k") * (2 * F.col(place) + 1) / (2 * n)))).alias("y"))
    drawn = spectrum.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    part = F.when(F.col("k") == 0, F.col("y")).otherwise(2 * F.col("y") * F.cos(math.pi * F.col("k") * (F.col("point") + 0.5) / points))
    return drawn.groupBy("point").agg(F.sum(part).alias("smooth"))


def density(places: DataFrame, key: str, place: str, scale: float, width: float, points: int = 1000) -> DataFrame:
    """key, sample, density: Gaussian densities of places at ``points`` samples from 0 to ``scale``, times scale / points.

    A place adds only to the samples within 8 widths of it (beyond, less than 1e-14 of a peak).  Equal places are counted
    first; then the places of a key within REACH widths are one group, whose kernels are summed as a matrix, so that a key of
    very many places is many groups.
    """
    step = scale / (points - 1)
    kind = places.schema[key].dataType.simpleString()
    n = places.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counted = places.groupBy(F.col(key).alias("k"), F.col(place).cast("double").alias("place")).agg(F.count(F.lit(1)).cast("double").alias("times"))

    def kernels(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        at, times = rows["place"].to_numpy(), rows["times"].to_numpy()
        low, high = max(0, math.ceil((at.min() - 8 * width) / step)), min(points - 1, math.floor((at.max() + 8 * width) / step))
        grid = np.arange(low, high + 1)
        sums = np.zeros(len(grid))
        for i in range(0, len(at), 1024):
            z = (grid * step - at[i : i + 1024, None]) / width
            sums += times[i : i + 1024] @ np.where(np.abs(z) <= 8, np.exp(-z * z / 2), 0.0)
        kept = sums > 0
        return pd.DataFrame({"k": [rows["k"].iat[0]] * int(kept.sum()), "sample": grid[kept], "s": sums[kept]}).astype({"k": rows["k"].dtype})

    parts = counted.where("place is not null").groupBy("k", F.floor(F.col("place") / (REACH * width)).alias("b")).applyInPandas(lambda _, rows: kernels(rows), f"k {kind}, sample int, s double")
    sums = parts.groupBy(F.col("k").alias(key), "sample").agg(F.sum("s").alias("s"))
    return sums.join(n, key).select(key, "sample", (F.col("s") / (F.col("n") * width * math.sqrt(2 * math.pi)) * scale / points).alias("density"))


def overlaps(curves: DataFrame, key: str, points: int = 1000) -> DataFrame:
    """x < y, overlap (area under both curves by trapezoids) and corr (Pearson, absent samples are 0) of every pair of curves.

    Pairs are those of curves that share a sample.  Curves are dealt to BLOCKS blocks and each pair of blocks is one
    group of matrices: joined by sample, every pair would cost as many rows as it has samples.
    """
    kind = curves.schema[key].dataType.simpleString()
    one = curves.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("sample", "density")).alias("c"))
    own = one.select("k", F.col("c.sample").alias("at"), F.col("c.density").alias("v"), F.pmod(F.xxhash64("k"), F.lit(BLOCKS)).cast("int").alias("b"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumns({"bx": F.least("b", "o"), "by": F.greatest("b", "o")}).drop("o")

    def pairs(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("k", ignore_index=True)
        m = np.zeros((len(rows), points))
        for i, (at, v) in enumerate(zip(rows["at"], rows["v"])):
            m[i, at] = v
        weight = np.ones(points)
        weight[[0, -1]] = 0.5
        s, q, names, block, out = m.sum(1), (m * m).sum(1), rows["k"].to_numpy(), rows["b"].to_numpy(), []
        dev = np.sqrt(np.maximum(q - s * s / points, 0))
        for i in range(len(rows)):
            j = np.arange(i + 1, len(rows))
            if rows["bx"].iat[0] != rows["by"].iat[0]:
                j = j[block[j] != block[i]]
            low = np.minimum(m[i], m[j])
            keep = low.any(1)
            j, low = j[keep], low[keep]
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(pd.DataFrame({"x": names[i], "y": names[j], "overlap": low @ weight, "corr": (m[j] @ m[i] - s[i] * s[j] / points) / (dev[i] * dev[j])}))
        return pd.concat(out)

    return met.groupBy("bx", "by").applyInPandas(pairs, f"x {kind}, y {kind}, overlap double, corr double")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n of equal bins from the least to the greatest value."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))
    return df.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
