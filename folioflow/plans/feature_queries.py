"""Queries of features fitted on one part of the articles and applied to all, each with the SQL it is held against."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from folioflow.operators import vectors as V
from folioflow.plans.registry import registry, table
from folioflow.plans.vector_queries import _B, _TF, counts

QUERIES, ORACLES, query = registry()

# Training articles are those with a rating; texts are those of the first delivery.
_TEXTS = "x AS (SELECT doc_number, arg_min(text, load_ts) AS text FROM df WHERE text IS NOT NULL GROUP BY 1), tr AS (SELECT DISTINCT doc_number FROM labels WHERE doc_number IN (SELECT doc_number FROM x))"
_COUNTS = (
    _TEXTS
    + r""", w AS (SELECT doc_number, list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda w: length(w) > 1) AS w FROM x),
    g AS (SELECT doc_number, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS feature FROM w), c AS (SELECT doc_number, feature, count(*) AS n FROM g GROUP BY 1, 2),
    f AS (SELECT feature, count(*) AS df FROM c WHERE doc_number IN (SELECT doc_number FROM tr) GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM tr) AND count(*) <= 0.5 * (SELECT count(*) FROM tr)),
    v AS (SELECT feature, df, row_number() OVER (ORDER BY feature) - 1 AS feature_id FROM f)"""
)


def texts(s, d):  # noqa: ANN001, ANN201
    return table(s, d, "df").where("text is not null").groupBy("doc_number").agg(F.min_by("text", "load_ts").alias("text"))


def rated(s, d):  # noqa: ANN001, ANN201
    return table(s, d, "labels").select("doc_number").distinct()


def fitted(s, d, binary=False):  # noqa: ANN001, ANN201
    """(counts of all articles, features fitted on the rated ones)."""
    every = V.count_features(texts(s, d), "doc_number", "text", 1, 2, binary)
    train = texts(s, d).join(rated(s, d), "doc_number", "left_semi")
    docs = train.agg(F.count(F.lit(1))).scalar()
    return every, V.fit_features(every.join(rated(s, d), "doc_number", "left_semi"), docs, 0.02, 0.5, "doc_number")


@query(f"WITH {_COUNTS} SELECT feature, feature_id, df FROM v")
def features_fitted(s, d):
    return fitted(s, d)[1]


@query(f"WITH {_COUNTS} SELECT doc_number, feature_id, n FROM c JOIN v USING (feature)")
def features_applied(s, d):
    every, fit = fitted(s, d)
    return V.apply_features(every, fit).select("doc_number", "feature_id", "n")


@query(f"WITH {_COUNTS} SELECT doc_number, count(*) AS n FROM c JOIN v USING (feature) GROUP BY 1")
def features_binary(s, d):
    every, fit = fitted(s, d, binary=True)
    return V.apply_features(every, fit).groupBy("doc_number").agg(F.sum("n").alias("n"))


_VARIANCE = f"""{_COUNTS}, a AS (SELECT doc_number, feature_id, n FROM c JOIN v USING (feature)), t AS (SELECT a.* FROM a JOIN tr USING (doc_number)), l AS (SELECT doc_number, sum(n) AS l FROM t GROUP BY 1),
    q AS (SELECT feature_id, sum((n / l::DOUBLE) * (n / l::DOUBLE)) - sum(n / l::DOUBLE) * sum(n / l::DOUBLE) / (SELECT count(*) FROM l) AS v FROM t JOIN l USING (doc_number) GROUP BY 1), z AS (SELECT feature_id, v / (SELECT max(v) FROM q) AS variance FROM q)"""


@query(f"WITH {_VARIANCE} SELECT doc_number, feature_id, round(n * variance, 6) AS weight FROM a JOIN z USING (feature_id)")
def variance_applied(s, d):
    """Term variance fitted on the rated articles, applied to all."""
    every, fit = fitted(s, d)
    bow = V.apply_features(every, fit).select("doc_number", "feature_id", "n")
    variance = V.term_variance(bow.join(rated(s, d), "doc_number", "left_semi"), "doc_number", "feature_id")
    return V.apply_variance(bow, variance, "feature_id").select("doc_number", "feature_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_TEXTS}, y AS (SELECT doc_number, length(text)::DOUBLE AS chars, len(string_split(text, '.'))::DOUBLE AS points FROM x), b AS (SELECT min(chars) AS cl, max(chars) AS ch, min(points) AS pl, max(points) AS ph FROM y JOIN tr USING (doc_number))
    SELECT doc_number, round(least(1.0, greatest(0.0, (chars - cl) / (ch - cl))), 6) AS chars, round(least(1.0, greatest(0.0, (points - pl) / (ph - pl))), 6) AS points FROM y, b""")
def scaled_by_train(s, d):
    """Lengths scaled by the bounds of the rated articles."""
    y = texts(s, d).select("doc_number", F.length("text").cast("double").alias("chars"), F.size(F.split("text", r"\.", -1)).cast("double").alias("points"))
    bounds = V.fit_bounds(y.join(rated(s, d), "doc_number", "left_semi"), ["chars", "points"])
    return V.scale_by(y, bounds, ["chars", "points"]).select("doc_number", F.round("chars", 6).alias("chars"), F.round("points", 6).alias("points"))


@query(f"WITH {_COUNTS}, a AS (SELECT doc_number, feature_id, n FROM c JOIN v USING (feature)), o AS (SELECT (SELECT max(feature_id) FROM a) + 1 AS o) SELECT doc_number, feature_id, n::BIGINT AS n FROM a UNION ALL SELECT doc_number, feature_id + o, length(text)::BIGINT FROM (SELECT doc_number, 0 AS feature_id, text FROM x), o")
def features_combined(s, d):
    """Words and, behind them, the length as one more feature."""
    fit = fitted(s, d)[1]
    words = V.count_fitted(texts(s, d), "doc_number", "text", fit, 1, 2)
    length = texts(s, d).select("doc_number", F.lit(0).cast("long").alias("feature_id"), F.length("text").cast("long").alias("n"))
    return V.combine_features([words, length], "doc_number", fitted={0: fit})


@query(f"WITH {_B} SELECT term_id, CASE WHEN count(*) < (SELECT count(DISTINCT doc_id) FROM b) THEN 0 ELSE min(n) END AS low, max(n) AS high FROM b GROUP BY 1")
def sparse_bounds(s, d):
    """Least and greatest count of every term over all articles, those without it included."""
    bow = counts(s, d)
    return V.bounds_of(bow, "term_id", others=bow.select("doc_id").distinct().agg(F.count(F.lit(1))).scalar())


_STOPS = "sp AS (SELECT DISTINCT term_id FROM vocab WHERE stop = 1)"


@query(f"""WITH {_B}, {_STOPS}, v AS (SELECT count(DISTINCT term_id) AS v FROM b), l AS (SELECT doc_id, sum(n) AS l FROM b GROUP BY 1), r AS (SELECT count(*) AS docs, sum(1 / (l + 1e-6 * v)) AS r, max(1 / (l + 1e-6 * v)) AS m FROM l, v),
    s AS (SELECT term_id, count(*) AS df, sum(n / (l + 1e-6 * v)) + 1e-6 * any_value(r) AS x, greatest(max((n + 1e-6) / (l + 1e-6 * v)), 1e-6 * any_value(m)) AS y, any_value(docs) AS docs FROM b JOIN l USING (doc_id), v, r WHERE term_id NOT IN (SELECT term_id FROM sp) GROUP BY 1)
    SELECT term_id, df, round(log2(docs / df::DOUBLE), 6) AS idf, round(x * log2(docs / df::DOUBLE), 6) AS tfidf_sum, round(x * log2(docs / df::DOUBLE) / docs, 9) AS tfidf_mean, round(y * log2(docs / df::DOUBLE), 6) AS tfidf_max FROM s""")
def tfidf_vocab_stats(s, d):
    """Weights of the terms that are no stop words, summed up for the vocabulary."""
    bow = counts(s, d)
    terms = bow.select("term_id").distinct().agg(F.count(F.lit(1))).scalar()
    out = V.tf_idf_stats(bow, table(s, d, "vocab").where("stop = 1"), terms)
    return out.select("term_id", "df", F.round("idf", 6).alias("idf"), F.round("tfidf_sum", 6).alias("tfidf_sum"), F.round("tfidf_mean", 9).alias("tfidf_mean"), F.round("tfidf_max", 6).alias("tfidf_max"))


@query(f"WITH {_TF}, {_STOPS}, k AS (SELECT term_id FROM b WHERE term_id NOT IN (SELECT term_id FROM sp) GROUP BY 1 ORDER BY sum(n) DESC, term_id LIMIT 200) SELECT doc_id, term_id, round(f, 9) AS f FROM t WHERE term_id IN (SELECT term_id FROM k)")
def tfidf_small(s, d):
    """Weights of the two hundred most frequent terms that are no stop words."""
    bow = counts(s, d)
    stop = table(s, d, "vocab").where("stop = 1").select("term_id").distinct()
    most = V.top(bow.groupBy("term_id").agg(F.sum("n").alias("n")).join(stop, "term_id", "left_anti"), "n", "term_id", 200)
    return V.restrict(V.tf_idf(bow), most).select("doc_id", "term_id", F.round("f", 9).alias("f"))


@query(f"WITH {_TF}, n AS (SELECT term_id, min(term_str) AS term_str FROM vocab GROUP BY 1) SELECT doc_id, term_id, term_str, round(f, 9) AS f FROM t LEFT JOIN n USING (term_id)")
def tfidf_with_terms(s, d):
    names = table(s, d, "vocab").groupBy("term_id").agg(F.min("term_str").alias("term_str"))
    return V.tf_idf(counts(s, d)).join(names, "term_id", "left").select("doc_id", "term_id", "term_str", F.round("f", 9).alias("f"))


@query(r"""SELECT token_str, CASE WHEN regexp_matches(token_str, '[\pL\pM\pN]') AND NOT regexp_matches(token_str, '[0-9]') THEN regexp_replace(lower(token_str), '["''_*.\\/0-9\s-]', '', 'g') END AS term_str, count(*) AS n FROM token WHERE token_str IS NOT NULL GROUP BY ALL""")
def token_flags_strict(s, d):
    return V.flag_tokens_strict(table(s, d, "token").where("token_str is not null").select("token_str")).groupBy("token_str", "term_str").agg(F.count(F.lit(1)).alias("n"))


# A grid of parameters: every combination of the choices.
GRID = {"count_kind": ["binary", "scaled", "augmented"], "weighting": ["none", "tfidf", "variance"], "least": [0.01, 0.02], "longest": [1, 2, 3]}


@query("SELECT count_kind, weighting, least::DOUBLE AS least, longest::INTEGER AS longest FROM (VALUES ('binary'), ('scaled'), ('augmented')) a(count_kind), (VALUES ('none'), ('tfidf'), ('variance')) b(weighting), (VALUES (0.01), (0.02)) c(least), (VALUES (1), (2), (3)) e(longest)")
def parameter_grid(s, d):
    """All settings of a feature run, one row each."""
    return s.createDataFrame(list(product(*GRID.values())), "count_kind string, weighting string, least double, longest int")


_WEIGHTED = f"{_COUNTS}, a AS (SELECT doc_number, feature_id, n, df FROM c JOIN v USING (feature)), r AS (SELECT doc_number, feature_id, n * (ln((1 + (SELECT count(*) FROM tr)) / (1 + df)::DOUBLE) + 1) AS w FROM a)"


@query(f"WITH {_WEIGHTED} SELECT doc_number, feature_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_number)), 9) AS weight FROM r")
def vectorized_tfidf(s, d):
    """The whole run: counts scaled, weighted, fitted on the rated articles."""
    out = V.vectorize(texts(s, d), rated(s, d), "doc_number", "text", "scaled", "tfidf", 0.02, 0.5, 1, 2)
    return out.withColumn("weight", F.round("weight", 9))


@query(f"WITH {_COUNTS} SELECT doc_number, feature_id, round(0.5 + 0.5 * n / (max(n) OVER (PARTITION BY doc_number))::DOUBLE, 9) AS weight FROM c JOIN v USING (feature)")
def vectorized_augmented(s, d):
    out = V.vectorize(texts(s, d), rated(s, d), "doc_number", "text", "augmented", "none", 0.02, 0.5, 1, 2)
    return out.withColumn("weight", F.round("weight", 9))


@query()
def svd_reduce(s, d):
    """Articles in the twenty greatest singular directions of the three hundred most frequent terms."""
    from pyspark.ml.functions import vector_to_array

    bow = counts(s, d)
    most = V.top(bow.groupBy("term_id").agg(F.sum("n").alias("n")), "n", "term_id", 300)
    return V.reduce_dimensions(V.restrict(bow, most), 20).select("doc_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))
