"""Queries of tokens, vocabulary and the vector space, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioflow.operators import vectors as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """Words of known articles, each place once; together: shuffled once, by article, so that grouping by article needs no other."""
    t = table(spark, d, "token").where("doc_id is not null and punc = 0 and num = 0")
    if together:
        t = t.select("doc_id", "sentence_num", "token_num", "term_id", "term_str").repartition("doc_id")
    return t.groupBy("doc_id", "sentence_num", "token_num").agg(F.min(F.struct("term_id", "term_str")).alias("t")).select("doc_id", "sentence_num", "token_num", "t.term_id", "t.term_str")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return V.bag(words(spark, d))


_W = "w AS (SELECT doc_id, sentence_num, token_num, min(term_id) AS term_id, min(term_str) AS term_str FROM token WHERE doc_id IS NOT NULL AND punc = 0 AND num = 0 GROUP BY ALL)"
_B = _W + ", b AS (SELECT doc_id, term_id, count(*) AS n FROM w GROUP BY 1, 2)"
_TF = _B + """, l AS (SELECT doc_id, sum(n) AS doc_n FROM b GROUP BY 1), s AS (SELECT term_id, count(*) AS df FROM b GROUP BY 1), d AS (SELECT count(*) AS docs FROM l),
    t AS (SELECT doc_id, term_id, n, df, n / doc_n::DOUBLE AS tf, log10(docs / df::DOUBLE) AS idf, n / doc_n::DOUBLE * log10(docs / df::DOUBLE) AS f FROM b JOIN l USING (doc_id) JOIN s USING (term_id), d)"""


@query(f"WITH {_TF}, m AS (SELECT term_id, avg(f) AS mean_f FROM t GROUP BY 1) SELECT term_id, round(mean_f, 9) AS mean_f FROM m ORDER BY round(mean_f, 9) DESC, term_id LIMIT 20")
def tfidf_top(s, d):
    mean = V.tf_idf(counts(s, d)).groupBy("term_id").agg(F.round(F.avg("f"), 9).alias("mean_f"))
    return V.top(mean, "mean_f", "term_id", 20)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pM\pN_]+|[^\pL\pM\pN_\s\x{0B}\pZ\x{1C}-\x{1F}\x{85}]') AS w FROM documents)
    SELECT doc_id, unnest(range(len(w)))::INTEGER AS token_num, unnest(w) AS token_str FROM t""")
def token_table(s, d):
    """Tokens of all texts."""
    return V.split_tokens(table(s, d, "documents"), "doc_id", "text")


@query(r"""SELECT token_str, (NOT regexp_matches(token_str, '[\pL\pM\pN]'))::INTEGER AS punc, regexp_matches(token_str, '[0-9]')::INTEGER AS num,
    CASE WHEN regexp_matches(token_str, '[\pL\pM\pN]') AND NOT regexp_matches(token_str, '[0-9]') THEN regexp_replace(lower(token_str), '["_*.]', '', 'g') END AS term_str, count(*) AS n FROM token WHERE token_str IS NOT NULL GROUP BY ALL""")
def token_flags(s, d):
    flagged = V.flag_tokens(table(s, d, "token").where("token_str is not null").select("token_str"))
    return flagged.groupBy("token_str", "punc", "num", "term_str").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_W}, c AS (SELECT term_str, count(*) AS n FROM w WHERE term_str IS NOT NULL GROUP BY 1) SELECT term_str, n, round(n / (SELECT sum(n) FROM c)::DOUBLE, 9) AS p FROM c")
def vocab(s, d):
    return V.vocabulary(words(s, d)).withColumn("p", F.round("p", 9))


@query("SELECT term_str, max(CASE WHEN stop = 1 THEN 1 ELSE 0 END)::INTEGER AS stop FROM vocab WHERE term_str IS NOT NULL GROUP BY 1")
def vocab_stop(s, d):
    return table(s, d, "vocab").where("term_str is not null").groupBy("term_str").agg(F.max(F.when(F.col("stop") == 1, 1).otherwise(0)).alias("stop"))


@query(f"WITH {_W} SELECT term_str, row_number() OVER (ORDER BY term_str) - 1 AS term_id, count(*) AS n FROM w WHERE term_str IS NOT NULL GROUP BY 1")
def term_ids(s, d):
    from folioflow.operators.corpus import renumber

    v = V.vocabulary(words(s, d)).select("term_str", "n")
    return renumber(v, "term_str", "term_id").withColumn("term_id", (F.col("term_id") - 1).cast("long"))


@query(f"WITH {_W} SELECT term_str, count(*) AS n FROM w WHERE term_str NOT IN (SELECT term_str FROM vocab WHERE stop = 1 AND term_str IS NOT NULL) GROUP BY 1 ORDER BY n DESC, term_str LIMIT 100")
def top_terms(s, d):
    stop = table(s, d, "vocab").where("stop = 1 and term_str is not null").select("term_str").distinct()
    return V.top(V.vocabulary(words(s, d)).join(stop, "term_str", "left_anti").select("term_str", "n"), "n", "term_str", 100)


@query(f"WITH {_W}, t AS (SELECT term_str, count(*) AS n FROM w WHERE term_str IS NOT NULL GROUP BY 1 ORDER BY n DESC, term_str LIMIT 300) SELECT term_str, n, (row_number() OVER (ORDER BY n DESC, term_str) - 1) // 50 AS bucket FROM t")
def term_buckets(s, d):
    t = V.top(V.vocabulary(words(s, d)).select("term_str", "n"), "n", "term_str", 300)
    return t.withColumn("bucket", F.floor((F.row_number().over(Window.orderBy(F.desc("n"), "term_str")) - 1) / 50))


@query(f"WITH {_B} SELECT * FROM b")
def bow(s, d):
    return counts(s, d)


@query("SELECT DISTINCT doc_id, year, month, day, section FROM doc WHERE doc_key NOT IN ('pm', 'billion', 'million', 'am')")
def doc_table(s, d):
    return table(s, d, "doc").where(~F.col("doc_key").isin("pm", "billion", "million", "am")).select("doc_id", "year", "month", "day", "section").distinct()


@query(f"WITH {_B}, l AS (SELECT doc_id, sum(n)::BIGINT AS term_count FROM b GROUP BY 1) SELECT doc_id, term_count, round(term_count / (SELECT sum(term_count) FROM l)::DOUBLE, 9) AS share FROM l")
def doc_term_share(s, d):
    length = counts(s, d).groupBy("doc_id").agg(F.sum("n").alias("term_count"))
    return length.withColumn("share", F.round(F.col("term_count") / length.agg(F.sum("term_count")).scalar(), 9))


@query(f"WITH {_TF} SELECT doc_id, term_id, round(tf, 9) AS tf, round(idf, 9) AS idf, round(f, 9) AS f FROM t")
def tfidf(s, d):
    return V.tf_idf(counts(s, d)).select("doc_id", "term_id", *[F.round(c, 9).alias(c) for c in ("tf", "idf", "f")])


@query(f"WITH {_TF}, r AS (SELECT doc_id, term_id, round(f, 9) AS f FROM t), q AS (SELECT quantile_cont(f, 0.5) AS m FROM r) SELECT doc_id, term_id, f FROM r, q WHERE f > m")
def tfidf_above_median(s, d):
    r = V.tf_idf(counts(s, d)).select("doc_id", "term_id", F.round("f", 9).alias("f"))
    return r.where(F.col("f") > r.agg(F.percentile("f", F.lit(0.5))).scalar())


@query(f"""WITH {_B}, l AS (SELECT doc_id, sum(n) AS l FROM b GROUP BY 1), v AS (SELECT count(DISTINCT term_id) AS v FROM b), r AS (SELECT sum(1 / (l + 1e-6 * v)) AS r, max(1 / (l + 1e-6 * v)) AS m FROM l, v)
    SELECT term_id, count(*) AS df, round(sum(n / (l + 1e-6 * v)) + 1e-6 * any_value(r), 9) AS tf_sum, round(greatest(max((n + 1e-6) / (l + 1e-6 * v)), 1e-6 * any_value(m)), 9) AS tf_max FROM b JOIN l USING (doc_id), v, r GROUP BY 1""")
def tfidf_smoothed_stats(s, d):
    return V.tf_idf_smoothed(counts(s, d)).withColumns({c: F.round(c, 9) for c in ("tf_sum", "tf_max")})


@query(f"""WITH {_B}, s AS (SELECT term_id, count(*) AS df FROM b GROUP BY 1), d AS (SELECT count(DISTINCT doc_id) AS docs FROM b), r AS (SELECT doc_id, term_id, n * (ln((1 + docs) / (1 + df)::DOUBLE) + 1) AS w FROM b JOIN s USING (term_id), d)
    SELECT doc_id, term_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS f FROM r""")
def tfidf_l2(s, d):
    return V.tf_idf_unit(counts(s, d)).withColumn("f", F.round("f", 9))


@query(f"WITH {_B} SELECT doc_id, term_id, round(n / (SELECT max(n) FROM b)::DOUBLE, 9) AS scaled FROM b")
def scaled_counts(s, d):
    return V.scaled_counts(counts(s, d)).select("doc_id", "term_id", F.round("scaled", 9).alias("scaled"))


@query(f"WITH {_B} SELECT doc_id, term_id, round(0.5 + 0.5 * n / (max(n) OVER (PARTITION BY doc_id))::DOUBLE, 9) AS augmented FROM b")
def augmented_counts(s, d):
    return V.augmented_counts(counts(s, d)).select("doc_id", "term_id", F.round("augmented", 9).alias("augmented"))


@query(f"""WITH {_B}, l AS (SELECT doc_id, sum(n) AS l FROM b GROUP BY 1), v AS (SELECT term_id, sum((n / l::DOUBLE) * (n / l::DOUBLE)) - sum(n / l::DOUBLE) * sum(n / l::DOUBLE) / (SELECT count(*) FROM l) AS v FROM b JOIN l USING (doc_id) GROUP BY 1)
    SELECT term_id, round(v / (SELECT max(v) FROM v), 6) AS variance FROM v""")
def term_variance(s, d):
    return V.term_variance(counts(s, d)).withColumn("variance", F.round("variance", 6))


@query(f"""WITH {_TF}, nm AS (SELECT doc_id, sqrt(sum(f * f)) AS norm FROM t GROUP BY 1), u AS (SELECT doc_id, term_id, f / norm AS u FROM t JOIN nm USING (doc_id))
    SELECT x.doc_id AS doc_x, y.doc_id AS doc_y, round(sum(x.u * y.u), 6) AS cosine FROM u x JOIN u y USING (term_id) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2 HAVING sum(x.u * y.u) > 0.1000001""")
def doc_cosine(s, d):
    """Every article against every other; the words are shuffled once, by article, with what their terms need."""
    t = table(s, d, "token").where("doc_id is not null and punc = 0 and num = 0").select("doc_id", "sentence_num", "token_num", "term_id").repartition("doc_id")
    w = t.groupBy("doc_id", "sentence_num", "token_num").agg(F.min("term_id").alias("term_id"))
    return V.cosines(V.bag(w), 0.1000001, 6)


@query("""WITH v AS (SELECT term_str, sum(n)::BIGINT AS n FROM vocab WHERE term_str IS NOT NULL AND coalesce(stop, 0) = 0 AND n IS NOT NULL GROUP BY 1), q AS (SELECT quantile_cont(n, 0.94) AS q FROM v)
    SELECT term_str, n FROM v, q WHERE n > q AND n >= 3""")
def vocab_quantile_filter(s, d):
    v = table(s, d, "vocab").where("term_str is not null and coalesce(stop, 0) = 0 and n is not null").groupBy("term_str").agg(F.sum("n").alias("n"))
    return v.where((F.col("n") > v.agg(F.percentile("n", F.lit(0.94))).scalar()) & (F.col("n") >= 3))


@query("SELECT doc_id, round(least(1.0, greatest(0.0, (n_chars - 200) / (1200 - 200)::DOUBLE)), 3) AS scaled FROM documents")
def minmax_scale(s, d):
    return V.rescale(table(s, d, "documents").select("doc_id", "n_chars"), "n_chars", 200, 1200, 3).drop("n_chars")


@query("SELECT DISTINCT doc_number, subject, dense_rank() OVER (ORDER BY subject) - 1 AS code FROM labels")
def label_encode(s, d):
    from folioflow.operators.corpus import renumber

    codes = renumber(table(s, d, "labels").select("subject").where("subject is not null").distinct(), "subject", "code").withColumn("code", (F.col("code") - 1).cast("long"))
    return table(s, d, "labels").select("doc_number", "subject").distinct().join(codes, "subject")


@query("SELECT doc_number, max((subject = 'law')::INTEGER) AS law, max((subject = 'sport')::INTEGER) AS sport, max((subject = 'science')::INTEGER) AS science FROM labels GROUP BY 1")
def one_hot(s, d):
    return table(s, d, "labels").groupBy("doc_number").agg(*[F.max((F.col("subject") == x).cast("int")).alias(x) for x in ("law", "sport", "science")])


@query("SELECT topic, alpha, string_split(words, ' ')[1] AS first_word, len(string_split(words, ' '))::INTEGER AS n_words FROM topic_keys")
def topic_keys(s, d):
    w = F.split("words", " ")
    return table(s, d, "topic_keys").select("topic", "alpha", w[0].alias("first_word"), F.size(w).alias("n_words"))


@query()
def topic_model(s, d):
    """Topics of a fitted model with their ten words, in the form of topic_keys."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    docs = words(s, d).groupBy("doc_id").agg(F.collect_list("term_str").alias("words"))
    bag = CountVectorizer(inputCol="words", outputCol="features", minDF=0.01, maxDF=0.4).fit(docs)
    model = LDA(k=10, seed=7, maxIter=5).fit(bag.transform(docs))
    names = F.array(*[F.lit(w) for w in bag.vocabulary])
    return model.describeTopics(10).select("topic", F.array_join(F.transform("termIndices", lambda i: F.get(names, i)), " ").alias("words"))


@query()
def word_vectors(s, d):
    from pyspark.ml.feature import Word2Vec

    sents = words(s, d).groupBy("doc_id", "sentence_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_num", "term_str"))), lambda t: t["term_str"]).alias("terms"))
    return Word2Vec(vectorSize=32, minCount=20, windowSize=5, maxIter=1, seed=7, inputCol="terms", outputCol="v").fit(sents).getVectors().select("word", F.col("vector").cast("string").alias("vector"))


@query()
def pca_2d(s, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).withColumn("a", vector_to_array("p"))
    return out.select("vec_id", F.col("a")[0].alias("x"), F.col("a")[1].alias("y"))
