"""How distinctive a term is for a record (problem 6): probabilistic relevance weighting.

score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))

Tokens are shuffled once by place, so that repeats meet however many tokens a record has, and counted
by record and term before their second shuffle; all else works on these counts, which are shuffled
once for all uses (the sums over them read one and the same exchange).

Defined cases: tokens without record or term do not count, repeated rows of one place count
once (with the least term); a collection of one record gives scores, an empty one no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def relevance(df: DataFrame, term: str = "term_id", record: str = "doc_id", place: tuple[str, ...] = ("sentence_num", "token_num"), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """record, term, tf, df, length, score of every term of every record."""
    src = df.where(F.col(record).isNotNull() & F.col(term).isNotNull()).select(F.col(record).alias("_d"), F.col(term).alias("_t"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(place)])
    once = src.groupBy("_d", *[f"_p{i}" for i in range(len(place))]).agg(F.min("_t").alias("_t"))
    tf = once.groupBy("_d", "_t").agg(F.count(F.lit(1)).alias("tf"))
    length = tf.groupBy("_d").agg(F.sum("tf").alias("length"))
    # reads tf, too: a plan without it would be another exchange
    spread = tf.groupBy("_t").agg(F.count_if(F.col("tf") > 0).alias("df"))
    n, mean = length.agg(F.count(F.lit(1)).alias("n")).scalar(), length.agg(F.avg("length").alias("mean")).scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    out = tf.join(spread, "_t").join(length, "_d")
    return out.select(F.col("_d").alias(record), F.col("_t").alias(term), "tf", "df", "length", (idf * gain).alias("score"))
