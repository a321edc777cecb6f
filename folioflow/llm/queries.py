"""Queries of the problems of training text; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import leakage, lookalike, mixing, neardup, relevance, sentences, subjects, termfreq, truncation
from folioflow.plans.lineage import settle, spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cuts(_t(spark, d, "df")).where("cut").select("doc_number").distinct()


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cuts_by_source(truncation.find_cuts(_t(spark, d, "df"))).withColumn("share_cut", F.round("share_cut", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_t(spark, d, "df"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_t(spark, d, "df"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    counts = termfreq.term_counts(termfreq.words_only(_t(spark, d, "token")))
    return termfreq.mark_terms(counts).where("mark is not null").select(F.col("term").alias("term_str"), "mark")


def p3_vocab(spark: SparkSession, d: str) -> DataFrame:
    counts = termfreq.term_counts(termfreq.words_only(_t(spark, d, "token")))
    return termfreq.correct_vocab(_t(spark, d, "vocab"), termfreq.mark_terms(counts)).withColumn("p", F.round("p", 9))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_t(spark, d, "df"), ["doc_number"]).distinct()


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(_t(spark, d, "df"), _t(spark, d, "topic_keys"), _t(spark, d, "labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).select("doc_number", "subject")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_shares(_shares(spark, d)).withColumn("share", F.round("share", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scored = relevance.relevance(termfreq.words_only(_t(spark, d, "token")))
    return scored.where("tf >= 4 and df <= 8").select("doc_id", "term_id")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return relevance.relevance(termfreq.words_only(_t(spark, d, "token"))).withColumn("score", F.round("score", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Only unchanged runs count here, so the error budget is 0: two pieces of a run, one of which is whole."""
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"), budget=0).select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unmet_targets(_t(spark, d, "documents"), _t(spark, d, "source_targets")).select("source")


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(mixing.memberships(mixing.count_tokens(spread(_t(spark, d, "documents").select("doc_id", "source", "text")))))
    return mixing.draw(texts, _t(spark, d, "source_targets"))


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_drawn(spark, d), _t(spark, d, "source_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(spark, d, "documents").select("doc_id", "text"))
    return lookalike.unify(docs, scores=lookalike.pair_scores(docs)).where(F.size("kinds") > 0).select("doc_id").distinct()


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(spark, d, "documents").select("doc_id", "text"))
    return lookalike.unify(docs, scores=lookalike.pair_scores(docs)).select("doc_id", "text_norm", F.array_join("kinds", ",").alias("kinds"))


_WORDS = "(SELECT doc_id, sentence_num, token_num, min(term_str) AS term_str, min(term_id) AS term_id FROM token WHERE doc_id IS NOT NULL AND punc = 0 AND num = 0 GROUP BY ALL)"

ORACLES: dict[str, str] = {
    "p3_found": f"""WITH w AS {_WORDS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM w), c AS (SELECT term_str, count(DISTINCT doc_id) AS r FROM w WHERE term_str IS NOT NULL GROUP BY 1)
        SELECT term_str, CASE WHEN r <= 2 THEN 'rare' ELSE 'common' END AS mark FROM c, n WHERE r <= 2 OR 3 * r > 2 * n""",
    "p3_vocab": f"""WITH w AS {_WORDS}, n AS (SELECT count(DISTINCT doc_id) AS n, count(term_str) AS all_n FROM w),
        c AS (SELECT term_str, count(*) AS occ, count(DISTINCT doc_id) AS r FROM w WHERE term_str IS NOT NULL GROUP BY 1),
        v AS (SELECT term_str, min(term_id) AS term_id, min(port_stem) AS port_stem, sum(CASE stop WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) > 0 AS s FROM vocab WHERE term_str IS NOT NULL GROUP BY 1)
        SELECT term_id, term_str, coalesce(occ, 0)::BIGINT AS n, round(coalesce(occ, 0) / all_n::DOUBLE, 9) AS p, coalesce(r, 0)::BIGINT AS records, port_stem,
        (coalesce(s, false) OR coalesce(r > 2 AND 3 * r > 2 * n.n, false))::INTEGER AS stop, CASE WHEN r <= 2 THEN 'rare' WHEN 3 * r > 2 * n.n THEN 'common' END AS mark
        FROM v FULL JOIN c USING (term_str), n""",
    "p6_found": f"""WITH w AS {_WORDS}, t AS (SELECT doc_id, term_id, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT term_id, count(*) AS df FROM t GROUP BY 1)
        SELECT doc_id, term_id FROM t JOIN f USING (term_id) WHERE tf >= 4 AND df <= 8""",
    "p6_scores": f"""WITH w AS {_WORDS}, t AS (SELECT doc_id, term_id, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT term_id, count(*) AS df FROM t GROUP BY 1),
        l AS (SELECT doc_id, sum(tf)::BIGINT AS length FROM t GROUP BY 1), n AS (SELECT count(*) AS n, avg(length) AS m FROM l)
        SELECT doc_id, term_id, tf, df, length, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m)), 6) AS score
        FROM t JOIN f USING (term_id) JOIN l USING (doc_id), n""",
    "p9_found": """WITH s AS (SELECT source, sum(n_chars) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
        SELECT source FROM source_targets LEFT JOIN s USING (source) WHERE target_share * (SELECT sum(n_chars) FROM documents) > max_repeats * coalesce(n, 0)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
