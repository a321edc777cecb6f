"""Queries of sentiment, smoothing, densities and networks, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators import signals as G
from folioflow.plans.vector_queries import ORACLES as VECTOR_SQL, table, vocab_quantile_filter, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The lexicon is the table of key words: a column for each subject, as a lexicon of feelings has one for each feeling.
FEELINGS = ["arts", "education", "finance", "health", "law", "politics", "science", "sport", "technology", "transport"]
# Valence is the first of these less the second.
POLES = ("sport", "law")
# Document numbers a part of a month's words may span, so that no string grows with the collection.
PART_IDS = 4096
_LEX = "lex AS (SELECT term_str, " + ", ".join(f"max((subject = '{f}')::INTEGER) AS {f}" for f in FEELINGS) + " FROM (SELECT subject, lower(unnest(string_split(words, ' '))) AS term_str FROM topic_keys) WHERE term_str <> '' GROUP BY 1)"
_W = "w AS (SELECT doc_id, sentence_num, token_num, min(term_id) AS term_id, min(term_str) AS term_str FROM token WHERE doc_id IS NOT NULL AND punc = 0 AND num = 0 GROUP BY ALL)"
_D = "d AS (SELECT doc_id, min(make_date(year, month, day)) AS day, min(section) AS section FROM doc GROUP BY 1)"
_S = f"{_LEX}, {_W}, {_D}, s AS (SELECT w.doc_id, day, section, token_num, " + ", ".join(f"coalesce({f}, 0) AS {f}" for f in FEELINGS) + " FROM w JOIN d USING (doc_id) LEFT JOIN lex USING (term_str))"
_SUMS = ", ".join(f"sum({f})::BIGINT AS {f}" for f in FEELINGS)


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lexicon(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "topic_keys").select("subject", F.explode(F.split(F.lower("words"), " ")).alias("term_str")).where("term_str <> ''")
    return words.groupBy("term_str").agg(*[F.max((F.col("subject") == f).cast("int")).alias(f) for f in FEELINGS])


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc").groupBy("doc_id").agg(F.min(F.make_date("year", "month", "day")).alias("day"), F.min("section").alias("section"))


def scored(s: SparkSession, d: str) -> DataFrame:
    return G.score(words(s, d), lexicon(s, d), FEELINGS).join(docs(s, d), "doc_id")


@query(f"WITH {_S} SELECT doc_id, {_SUMS} FROM s GROUP BY 1")
def sentiment_by_article(s, d):
    return G.sums_by(scored(s, d), FEELINGS, ["doc_id"])


@query(f"WITH {_S} SELECT day, {_SUMS} FROM s GROUP BY 1")
def sentiment_by_date(s, d):
    return G.sums_by(scored(s, d), FEELINGS, ["day"])


@query(f"WITH {_S} SELECT year(day)::INTEGER AS year, month(day)::INTEGER AS month, {_SUMS} FROM s GROUP BY 1, 2")
def sentiment_by_month(s, d):
    return G.sums_by(scored(s, d).withColumns({"year": F.year("day"), "month": F.month("day")}), FEELINGS, ["year", "month"])


@query(f"WITH {_S} SELECT section, {_SUMS} FROM s GROUP BY 1")
def sentiment_by_section(s, d):
    return G.sums_by(scored(s, d), FEELINGS, ["section"])


@query(f"WITH {_S} SELECT day, {_SUMS} FROM s WHERE section = 'International' GROUP BY 1")
def sentiment_section_filter(s, d):
    return G.sums_by(scored(s, d).where("section = 'International'"), FEELINGS, ["day"])


@query(f"WITH {_S}, p AS (SELECT year(day)::INTEGER AS year, month(day)::INTEGER AS month, section, " + ", ".join(FEELINGS) + f" FROM s) SELECT year, month, section, 3 - grouping_id(year, month, section) // 4 - grouping_id(year, month, section) // 2 % 2 - grouping_id(year, month, section) % 2 AS depth, {_SUMS} FROM p GROUP BY ROLLUP (year, month, section)")
def sentiment_by_prefix(s, d):
    t = scored(s, d).withColumns({"year": F.year("day"), "month": F.month("day")})
    return G.sums_of_prefixes(t, FEELINGS, ["year", "month", "section"])


@query(f"WITH {_S}, t AS (SELECT {_SUMS} FROM s) SELECT feeling, total FROM t UNPIVOT (total FOR feeling IN (" + ", ".join(FEELINGS) + "))")
def emotion_totals(s, d):
    return G.unpivot_sums(scored(s, d), FEELINGS)


@query(f"WITH {_W}, {_D} SELECT year(day)::INTEGER AS year, month(day)::INTEGER AS month, doc_id // {PART_IDS} AS part_no, string_agg(term_str, ' ' ORDER BY doc_id, sentence_num, token_num) AS month_str FROM w JOIN d USING (doc_id) GROUP BY 1, 2, 3")
def month_strings(s, d):
    """All words of a month in order, in parts of PART_IDS document numbers: the parts joined by part_no are the month."""
    ordered = F.array_sort(F.collect_list(F.struct("sentence_num", "token_num", "term_str")))
    each = words(s, d, together=True).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["term_str"]), " ").alias("str"))
    t = each.join(docs(s, d), "doc_id").groupBy(F.year("day").alias("year"), F.month("day").alias("month"), F.floor(F.col("doc_id") / PART_IDS).alias("part_no"))
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "str")))
    return t.agg(F.array_join(F.transform(F.filter(parts, lambda x: x["str"] != ""), lambda x: x["str"]), " ").alias("month_str"))


_MONTHS = f"{_S}, m AS (SELECT year(day)::INTEGER * 12 + month(day)::INTEGER - 1 AS month, (sum({POLES[0]}) - sum({POLES[1]}))::BIGINT AS valence FROM s GROUP BY 1)"


def months(s: SparkSession, d: str) -> DataFrame:
    t = scored(s, d).groupBy((F.year("day") * 12 + F.month("day") - 1).alias("month"))
    return t.agg((F.sum(POLES[0]) - F.sum(POLES[1])).alias("valence"))


@query(f"WITH {_MONTHS} SELECT month, valence FROM m ORDER BY valence DESC, month LIMIT 7")
def top_months(s, d):
    return months(s, d).orderBy(F.desc("valence"), "month").limit(7)


@query(f"WITH {_MONTHS} SELECT month, valence FROM m ORDER BY valence, month LIMIT 7")
def bottom_months(s, d):
    return months(s, d).orderBy("valence", "month").limit(7)


@query(f"WITH {_MONTHS} SELECT month, valence, sign(valence)::INTEGER AS colour FROM m")
def valence_sign(s, d):
    return months(s, d).withColumn("colour", F.signum("valence").cast("int"))


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(49, floor((value - lo) / ((hi - lo) / 50)))::INTEGER AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1""")
def histogram_50(s, d):
    return G.histogram(table(s, d, "events"), "value", 50)


_SERIES = f"{_MONTHS}, o AS (SELECT month, valence, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM m)"


@query(f"""WITH {_SERIES}, k AS (SELECT unnest(range(5)) AS k), y AS (SELECT k, 2 * sum(valence * cos(pi() * k * (2 * i + 1) / (2 * n))) AS y FROM o, k GROUP BY 1), g AS (SELECT unnest(range(100)) AS point)
    SELECT point::INTEGER AS point, round(sum(CASE WHEN k = 0 THEN y ELSE 2 * y * cos(pi() * k * (point + 0.5) / 100) END), 6) AS smooth FROM g, y GROUP BY 1""")
def dct_lowpass(s, d):
    from folioflow.operators.corpus import renumber

    series = renumber(months(s, d), "month", "i").withColumn("i", F.col("i") - 1)
    return G.low_pass(series, "i", "valence", series.agg(F.count(F.lit(1))).scalar()).withColumn("smooth", F.round("smooth", 6))


@query(f"""WITH {_SERIES}, p AS (SELECT a.month, count(*) AS c, sum(b.valence * (3 - abs(a.i - b.i)) / 3.0) AS v FROM o a JOIN o b ON abs(a.i - b.i) <= 2 GROUP BY 1)
    SELECT month, round(CASE WHEN c = 5 THEN v END, 6)::DOUBLE AS rolling_sum, round(CASE WHEN c = 5 THEN v / 3 END, 6)::DOUBLE AS rolling_mean FROM p""")
def rolling_triangle(s, d):
    out = G.rolling_triangle(months(s, d), "month", "valence", 5)
    return out.select("month", F.round("rolling_sum", 6).alias("rolling_sum"), F.round("rolling_mean", 6).alias("rolling_mean"))


# Samples of a curve, friends of a term and edges of the network, as in the reference.
SAMPLES, FRIENDS, EDGES = 1000, 10, 1000
# Places a part of a term's list may span.
PART_DAYS = 100
# Places of a term are its day's number since 1999, so that no global order of tokens is needed; terms are those of the filtered vocabulary.
_KEPT = VECTOR_SQL["vocab_quantile_filter"].replace("WITH v AS", "kv AS (WITH v AS", 1) + ")"
_PLACES = f"{_W}, {_D}, {_KEPT}, pl AS (SELECT term_str, (day - DATE '1999-01-01')::INTEGER AS place FROM w JOIN d USING (doc_id) WHERE term_str IN (SELECT term_str FROM kv) AND day IS NOT NULL)"
_KDE = f"""n AS (SELECT term_str, count(*) AS n FROM pl GROUP BY 1), pc AS (SELECT term_str, place, count(*) AS times FROM pl GROUP BY 1, 2), g AS (SELECT unnest(range({SAMPLES})) AS sample),
    k AS (SELECT term_str, sample::INTEGER AS sample, sum(times * exp(-power((sample * 1500 / {SAMPLES - 1}.0 - place) / 60, 2) / 2)) / (any_value(n) * 60 * sqrt(2 * pi())) * 1500 / {SAMPLES} AS density FROM pc JOIN n USING (term_str), g
    WHERE abs(sample * 1500 / {SAMPLES - 1}.0 - place) <= 480 GROUP BY 1, 2)"""


def places(s: SparkSession, d: str) -> DataFrame:
    """Places of the terms that the vocabulary's filter keeps."""
    t = words(s, d, together=True).join(vocab_quantile_filter(s, d).select("term_str"), "term_str", "left_semi")
    return t.join(docs(s, d), "doc_id").select("term_str", F.date_diff("day", F.lit("1999-01-01").cast("date")).alias("place"))


def curves(s: SparkSession, d: str) -> DataFrame:
    return G.density(places(s, d), "term_str", "place", 1500, 60, SAMPLES)


@query(f"WITH {_PLACES}, {_KDE} SELECT term_str, sample, round(density, 9) AS density FROM k")
def term_kde(s, d):
    return curves(s, d).withColumn("density", F.round("density", 9))


@query(f"WITH {_PLACES}, {_KDE} SELECT term_str, arg_max(sample, round(density, 9)) AS peak FROM k GROUP BY 1")
def peak_position(s, d):
    return curves(s, d).groupBy("term_str").agg(F.max_by("sample", F.round("density", 9)).alias("peak"))


@query(f"WITH {_PLACES} SELECT term_str, (place // {PART_DAYS})::BIGINT AS part_no, list_sort(list(place)) AS places FROM pl GROUP BY 1, 2")
def term_offsets(s, d):
    """Sorted places of a term, in parts of PART_DAYS days: the parts joined by part_no are its list."""
    return places(s, d).groupBy("term_str", F.floor(F.col("place") / PART_DAYS).alias("part_no")).agg(F.sort_array(F.collect_list("place")).alias("places"))


_PAIRS = f"""{_PLACES}, {_KDE}, t AS (SELECT DISTINCT term_str FROM k), full_k AS (SELECT term_str, g.sample::INTEGER AS sample, coalesce(density, 0) AS density FROM t CROSS JOIN g LEFT JOIN k USING (term_str, sample)),
    pr AS (SELECT a.term_str AS x, b.term_str AS y, sum(least(a.density, b.density) * CASE WHEN sample IN (0, {SAMPLES - 1}) THEN 0.5 ELSE 1 END) AS overlap, corr(a.density, b.density) AS corr FROM full_k a JOIN full_k b USING (sample) WHERE a.term_str < b.term_str GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT x, y, round(overlap, 6) AS overlap FROM pr WHERE overlap > 1e-9")
def pair_overlap(s, d):
    return G.overlaps(curves(s, d), "term_str", SAMPLES).select("x", "y", F.round("overlap", 6).alias("overlap")).where("overlap > 1e-9")


@query(f"WITH {_PAIRS} SELECT x, y, round(corr, 6) AS corr FROM pr WHERE overlap > 1e-9")
def pair_corr(s, d):
    return G.overlaps(curves(s, d), "term_str", SAMPLES).where("overlap > 1e-9").select("x", "y", F.round("corr", 6).alias("corr"))


@query(f"WITH {_PAIRS}, sy AS (SELECT x, y, round(overlap, 6) AS overlap FROM pr UNION ALL SELECT y, x, round(overlap, 6) FROM pr) SELECT x, y, overlap FROM sy QUALIFY row_number() OVER (PARTITION BY x ORDER BY overlap DESC, y) <= {FRIENDS}")
def friends(s, d):
    from folioflow.operators.vectors import top_each

    p = G.overlaps(curves(s, d), "term_str", SAMPLES).select("x", "y", F.round("overlap", 6).alias("overlap"))
    both = p.unionByName(p.select(F.col("y").alias("x"), F.col("x").alias("y"), "overlap"))
    return top_each(both, "x", "overlap", "y", FRIENDS).drop("place")


@query(f"WITH {_PAIRS} SELECT x, y, round(overlap, 6) AS overlap FROM pr ORDER BY round(overlap, 6) DESC, x, y LIMIT {EDGES}")
def top_edges(s, d):
    return G.overlaps(curves(s, d), "term_str", SAMPLES).select("x", "y", F.round("overlap", 6).alias("overlap")).orderBy(F.desc("overlap"), "x", "y").limit(EDGES)


_FELT = f"{_S}, pl AS (SELECT feeling AS term_str, (day - DATE '1999-01-01')::INTEGER AS place FROM (SELECT day, feeling, v FROM s UNPIVOT (v FOR feeling IN ({', '.join(FEELINGS)}))) WHERE v > 0 AND day IS NOT NULL)"


@query(f"WITH {_FELT}, {_KDE} SELECT term_str AS feeling, sample, round(density, 9) AS density FROM k")
def feeling_kde(s, d):
    """Densities of all feelings over the days."""
    t = scored(s, d).withColumn("feeling", F.explode(F.array_compact(F.array(*[F.when(F.col(f) > 0, F.lit(f)) for f in FEELINGS]))))
    felt = t.where("day is not null").select("feeling", F.date_diff("day", F.lit("1999-01-01").cast("date")).alias("place"))
    return G.density(felt, "feeling", "place", 1500, 60, SAMPLES).withColumn("density", F.round("density", 9))


@query(f"WITH {_PAIRS}, t20 AS (SELECT term_str FROM n ORDER BY n DESC, term_str LIMIT 20) SELECT x, y, round(coalesce(overlap, 1), 6) AS overlap FROM (SELECT a.term_str AS x, b.term_str AS y FROM t20 a, t20 b) g LEFT JOIN (SELECT x, y, overlap FROM pr WHERE overlap > 1e-9 UNION ALL SELECT y, x, overlap FROM pr WHERE overlap > 1e-9) o USING (x, y)")
def overlap_crosstab(s, d):
    """Overlaps of the twenty most frequent terms crosswise, 1 where there is none (a term with itself), in long form."""
    p = places(s, d)
    most = p.groupBy("term_str").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term_str").limit(20).select("term_str")
    pairs = G.overlaps(G.density(p.join(most, "term_str", "left_semi"), "term_str", "place", 1500, 60, SAMPLES), "term_str", SAMPLES).where("overlap > 1e-9")
    both = pairs.select("x", "y", "overlap").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "overlap"))
    names = [r["term_str"] for r in most.collect()]  # twenty at most
    wide = both.groupBy("x").pivot("y", names).agg(F.sum("overlap")).fillna(1, names)
    return wide.unpivot("x", names, "y", "overlap").withColumn("overlap", F.round("overlap", 6))
