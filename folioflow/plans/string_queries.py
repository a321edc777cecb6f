"""Queries of string similarity over whole tables; published values and brute force are in the tests.

Pairs are the name and type of every part, and the names of parts with neighbouring keys; lists are the
words of names, and the sections or names of a group.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from folioflow.functions import strings as X
from folioflow.plans.registry import registry, table

QUERIES, ORACLES, query = registry()


def neighbours(s, d):  # noqa: ANN001, ANN201
    """ka, kb, a, b: the names of parts with neighbouring keys."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("a"))
    q = p.select((F.col("ka") - 1).alias("ka"), F.col("ka").alias("kb"), F.col("a").alias("b"))
    return p.join(q, "ka")


def measured(s, d, name, f, kind):  # noqa: ANN001, ANN201
    return neighbours(s, d).select("ka", "kb", X.column(f, kind)("a", "b").alias(name))


_NEXT = "(SELECT x.p_partkey AS ka, y.p_partkey AS kb, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


@query(f"SELECT ka, kb, levenshtein(a, b)::INTEGER AS distance FROM {_NEXT}")
def levenshtein(s, d):
    return neighbours(s, d).select("ka", "kb", F.levenshtein("a", "b").alias("distance"))


@query("SELECT p_partkey, round(2.0 * least(length(p_name), length(p_type)) / (length(p_name) + length(p_type)), 9)::DOUBLE AS bound FROM part")
def real_quick_ratio(s, d):
    a, b = F.length("p_name"), F.length("p_type")
    return table(s, d, "part").select("p_partkey", F.round(2.0 * F.least(a, b) / (a + b), 9).alias("bound"))


@query(f"""WITH c AS (SELECT ka, kb, a, b, unnest(list_distinct(string_split(a, ''))) AS c FROM {_NEXT}), n AS (SELECT ka, kb, a, b, least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) AS n FROM c)
    SELECT ka, kb, round(2.0 * sum(n) / (length(any_value(a)) + length(any_value(b))), 6)::DOUBLE AS bound FROM n GROUP BY 1, 2""")
def quick_ratio(s, d):
    return measured(s, d, "bound", X.quick_ratio, T.DoubleType()).withColumn("bound", F.round("bound", 6))


@query(f"SELECT ka, kb, hamming(a[1:6], b[1:6])::INTEGER AS hamming FROM {_NEXT} WHERE length(a) >= 6 AND length(b) >= 6")
def hamming(s, d):
    """Differing places of the first six letters, of names as long."""
    long = neighbours(s, d).where((F.length("a") >= 6) & (F.length("b") >= 6))
    return long.select("ka", "kb", X.hamming_column(F.substring("a", 1, 6), F.substring("b", 1, 6)).alias("hamming"))


@query()
def edit_ratio(s, d):
    return measured(s, d, "ratio", X.ratio, T.DoubleType())


@query()
def jaro(s, d):
    return measured(s, d, "jaro", X.jaro, T.DoubleType())


@query()
def jaro_winkler(s, d):
    return measured(s, d, "jw", X.jaro_winkler, T.DoubleType())


@query(f"SELECT ka, kb, levenshtein(a, b)::INTEGER AS steps FROM {_NEXT}")
def edit_ops(s, d):
    """Steps of the least edit scripts: as many as the distance."""
    return neighbours(s, d).select("ka", "kb", F.size(X.column(X.edit_script, X.SCRIPT)("a", "b")).alias("steps"))


@query(f"SELECT ka, kb, b AS result FROM {_NEXT}")
def apply_edit(s, d):
    """What the script from a name to the next makes of the name: the next."""
    return measured(s, d, "result", lambda a, b: X.apply_script(X.edit_script(a, b), a, b), T.StringType())


@query(f"SELECT ka, kb, a AS result FROM {_NEXT}")
def inverse_ops(s, d):
    """What the inverse script makes of the next name: the name."""
    return measured(s, d, "result", lambda a, b: X.apply_script(X.inverse(X.edit_script(a, b)), b, a), T.StringType())


@query(f"SELECT ka, kb, b AS result FROM {_NEXT}")
def subtract_edit(s, d):
    """Half of a script, then what is left of it: the next name."""

    def halves(a: str, b: str) -> str:
        ops = X.edit_script(a, b)
        half = ops[: len(ops) // 2]
        return X.apply_script(X.subtract(ops, half), X.apply_script(half, a, b), b)

    return measured(s, d, "result", halves, T.StringType())


@query(f"SELECT ka, kb, true AS sound FROM {_NEXT}")
def matching_blocks(s, d):
    """Whether the blocks of two names are equal stretches of both, in order, and all that the least script keeps."""

    def sound(a: str, b: str) -> bool:
        blocks = X.matching_blocks(a, b)
        same = all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        kept = sum(n for *_, n in blocks)
        return same and kept == len(a) - sum(op != "insert" for op, _, _ in X.edit_script(a, b)) and blocks == sorted(blocks)

    return measured(s, d, "sound", sound, T.BooleanType())


OPCODES = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("s_from", "s_to", "d_from", "d_to")]]))


@query(f"SELECT ka, kb, a AS name, b AS result FROM {_NEXT}")
def edit_blocks(s, d):
    """The stretches of both names that the blocks cover, put together: both names."""
    t = neighbours(s, d).withColumn("o", X.column(X.opcodes, OPCODES)("a", "b"))
    cover = lambda text, low, high: F.array_join(F.transform("o", lambda x: F.substring(F.col(text), x[low] + 1, x[high] - x[low])), "")
    return t.select("ka", "kb", cover("a", "s_from", "s_to").alias("name"), cover("b", "d_from", "d_to").alias("result"))


@query()
def sequence_ratio(s, d):
    """Names compared word by word, in order."""
    words = neighbours(s, d).select("ka", "kb", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return words.select("ka", "kb", X.column(X.sequence_ratio, T.DoubleType())("a", "b").alias("ratio"))


@query()
def set_ratio(s, d):
    """Names compared word by word, in any order."""
    words = neighbours(s, d).select("ka", "kb", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return words.select("ka", "kb", X.column(X.set_ratio, T.DoubleType())("a", "b").alias("ratio"))


def spellings(s, d):  # noqa: ANN001, ANN201
    """g, w: the types of the parts of every brand and size, in order; at most a few each."""
    return table(s, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_size").alias("g")).agg(F.array_sort(F.collect_set("p_type")).alias("w"))


@query("""WITH g AS (SELECT p_brand || '/' || p_size AS g, list_sort(list(DISTINCT p_type)) AS w FROM part GROUP BY 1), p AS (SELECT g, w, unnest(range(1, len(w) + 1)) AS i FROM g),
    t AS (SELECT g, w[i] AS x, i, list_sum([levenshtein(w[i], y) FOR y IN w]) AS total FROM p) SELECT g, arg_min(x, [total, i]) AS median FROM t GROUP BY 1""")
def set_median(s, d):
    return spellings(s, d).select("g", X.column(X.set_median, T.StringType())("w").alias("median"))


@query()
def quick_median(s, d):
    return spellings(s, d).select("g", X.column(X.quick_median, T.StringType())("w").alias("median"))


@query()
def greedy_median(s, d):
    return spellings(s, d).select("g", X.column(X.greedy_median, T.StringType())("w").alias("median"))


@query()
def improve_median(s, d):
    """The quick median after a pass of improvements."""
    start = spellings(s, d).withColumn("a", X.column(X.quick_median, T.StringType())("w"))
    return start.select("g", X.column(X.improve_median, T.StringType())("a", "w").alias("median"))
