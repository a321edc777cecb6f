"""Nulls in any column, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import leakage, lookalike, mixing, neardup, relevance, sentences, subjects, termfreq, truncation

CLASHES = ["key", "c", "d", "g", "w", "h", "n", "p", "u", "t", "doc", "item", "name", "grams", "place", "words", "bucket", "tf", "df", "length", "cut", "term", "kinds", "text_norm", "members", "n_tokens", "start_char", "end_char", "_text", "_key", "part", "mark", "records"]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="module")
def articles(spark):
    long = "The bank rose again today. " * 4000
    rows = [
        (1, "A title", "The court heard the judge. The court rose.", "Law", "s1"), (1, "A title", "The court heard the judge. The court rose.", "Law", "s1"), (2, None, None, None, None), (3, "", "", "", ""), (4, None, "   \n ", None, "s1"),
        (5, "Long", long, "News", None), (6, "Long", long, None, "s2"), (7, "x", "!!! ... ???", "x", "s1"), (None, "t", "The court heard the judge. The court rose.", "Law", "s1"),
    ]
    return clash(spark.createDataFrame(rows, "doc_number long, title string, text string, section string, source string"))


def test_articles(spark, articles):
    keys = clash(spark.createDataFrame([(0, "court judge", "law"), (1, "bank", "finance"), (2, None, None)], "topic int, words string, subject string"))
    labels = clash(spark.createDataFrame([(1, "law", 1), (1, "law", 1), (99, "finance", 2), (None, None, None)], "doc_number long, subject string, rater int"))
    for df in (articles, articles.limit(0)):
        rows = df.count()
        pairs = {tuple(r) for r in neardup.similar_pairs(df).collect()}
        assert pairs == ({(5, 6)} if rows else set())
        assert neardup.similar_groups(df.where("doc_number is not null")).count() == (3 if rows else 0)
        assert {r.doc_number for r in sentences.sentences(df, ["doc_number"]).collect()} == ({1, 5, 6, None} if rows else set())
        assert {r.doc_number for r in truncation.find_cuts(df).collect()} == ({1, 5, 6, 7, None} if rows else set())
        assert truncation.cuts_by_source(truncation.find_cuts(df)).count() == (3 if rows else 0)
        subjects.subject_shares(df, keys, labels).collect()
        assert subjects.subject_shares(df, keys.limit(0), labels.limit(0)).count() == 0


def test_subjects_come_from_the_factorisation(spark, monkeypatch):
    texts = [(i, ("The court heard the judge. A judge sat in court." if i % 2 else "The bank lent money. A bank gave credit."), None) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_number long, text string, section string")
    keys = spark.createDataFrame([(0, "court judge", "law"), (1, "bank credit", "finance")], "topic int, words string, subject string")
    labels = spark.createDataFrame([], "doc_number long, subject string, rater int")
    got = {(r.doc_number, r.subject) for r in subjects.subject_shares(df, keys, labels).collect()}
    assert got == {(i, "law" if i % 2 else "finance") for i in range(40)}
    monkeypatch.setattr(subjects, "TELLING", 2.0)
    assert subjects.subject_shares(df, keys, labels).count() == 0


def test_documents(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    docs = clash(spark.createDataFrame([(1, run, "a"), (1, run, "a"), (2, None, None), (3, "", ""), (4, "word " * 50000 + run, "b"), (None, run, "a")], "doc_id long, text string, source string"))
    items = clash(spark.createDataFrame([(7, run), (7, run), (8, ""), (9, None), (None, run)], "item_id long, text string"))
    assert {(r.item_id, r.doc_id, r.changes) for r in leakage.find_leaks(docs, items).collect()} == {(7, 1, 0), (7, 4, 0), (7, None, 0)}
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0), budget=0).count() == 0
    unified = lookalike.unify(docs, scores=lookalike.pair_scores(docs))
    assert unified.count() == 6 and unified.where("text is null").first().text_norm is None
    assert lookalike.unify(docs.limit(0), scores=lookalike.pair_scores(docs.limit(0))).count() == 0
    sized = mixing.memberships(mixing.count_tokens(docs))
    targets = clash(spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("none", 0.1, 1), (None, 0.2, 1), ("z", None, None)], "source string, target_share double, max_repeats int"))
    assert {r.source for r in mixing.draw(sized, targets).collect()} <= {"a", "b"}
    assert mixing.draw(sized.limit(0), targets).count() == 0
    lengths = docs.withColumn("n_chars", F.length("text"))
    assert {r.source for r in mixing.unmet_targets(lengths, targets).collect()} >= {"none"}
    assert mixing.unmet_targets(lengths.limit(0), targets).count() == 0


def test_tokens(spark):
    rows = [(1, 0, 0, "bank", 3, 0, 0), (1, 0, 0, "bank", 3, 0, 0), (1, 0, 1, None, None, 0, 0), (None, 0, 0, "x", 4, 0, 0), (2, None, None, "bank", 3, 0, 0), (2, 0, 0, "", 5, None, None)]
    token = clash(spark.createDataFrame(rows, "doc_id long, sentence_num int, token_num int, term_str string, term_id int, punc int, num int"))
    words = termfreq.words_only(token)
    counts = {r.term: (r.occurrences, r.records) for r in termfreq.term_counts(words).collect()}
    assert counts["bank"] == (2, 2) and counts[None][1] == 2
    assert {(r.doc_id, r.term_id): (r.tf, r.df) for r in relevance.relevance(words).collect()} == {(1, 3): (1, 2), (2, 3): (1, 2)}
    assert termfreq.mark_terms(termfreq.term_counts(words.limit(0))).count() == 0 and relevance.relevance(words.limit(0)).count() == 0
