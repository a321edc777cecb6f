"""Fitted features, merges, files and string measures off the published examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import strings as X
from folioflow.operators import corpus as C, vectors as V
from folioflow.sources import files as S, vendors


def test_jaro_at_the_edge_of_the_reach():
    assert round(X.jaro("ab", "ba"), 4) == 0.8333  # both match one place away, out of turn: (1 + 1 + 1/2) / 3
    assert round(X.jaro("abcd", "cdab"), 4) == 0.8333  # reach 2: all four match, all out of turn: (1 + 1 + 1/2) / 3
    assert round(X.jaro("abcd", "xxxa"), 4) == 0.0  # three places away
    assert round(X.jaro("a", "ba"), 4) == round((1 + 0.5 + 1) / 3, 4) and X.jaro("a", "bca") == 0.0
    assert X.jaro("", "") == 1.0 and X.jaro("", "a") == 0.0 and X.jaro("abc", "xyz") == 0.0
    assert round(X.jaro_winkler("ab", "ba"), 4) == 0.8333 and round(X.jaro("Brian", "Jesus"), 6) == 0.0
    assert round(X.jaro("Thorkel", "Thorgier"), 6) == 0.779762 and round(X.jaro("Dinsdale", "D"), 6) == 0.708333


def test_published_lists():
    assert round(X.sequence_ratio(["newspaper", "litter bin", "tinny", "antelope"], ["caribou", "sausage", "gorn", "woody"]), 6) == 0.215179
    assert round(X.set_ratio(["newspaper", "litter bin", "tinny", "antelope"], ["caribou", "sausage", "gorn", "woody"]), 6) == 0.281845
    assert X.set_median(["ehee", "cceaes", "chees", "chreesc", "chees", "cheesee", "cseese", "chetese"]) == "chees"
    assert X.quick_median(["Levnhtein", "Leveshein", "Leenshten", "Leveshtei", "Lenshtein", "Lvenstein", "Levenhtin", "evenshtei"]) == "Levnshein"
    assert round(X.ratio("Hello world!", "Holly grail!"), 6) == 0.583333 and X.hamming("Hello world!", "Holly grail!") == 7 and X.quick_ratio("abc", "cab") == 1.0
    assert X.distance("Levenshtein", "Lenvinsten") == 4


def test_hamming_column(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(X.hamming_column(F.col("a"), F.col("b"))).collect()] == [1, 0, None]
    with pytest.raises(Exception, match="one length"):
        spark.createDataFrame([("a", "ab")], "a string, b string").select(X.hamming_column(F.col("a"), F.col("b"))).collect()


def test_features(spark):
    df = spark.createDataFrame([(1, "The bank, the river"), (2, "A bank of x"), (3, None), (4, "")], "k int, t string")
    counts = V.count_features(df, "k", "t", 1, 2)
    got = {(r.k, r.feature): r.n for r in counts.collect()}
    assert got == {(1, "the"): 2, (1, "bank"): 1, (1, "river"): 1, (1, "the bank"): 1, (1, "bank the"): 1, (1, "the river"): 1, (2, "bank"): 1, (2, "of"): 1, (2, "bank of"): 1}
    fit = {r.feature: (r.feature_id, r.df) for r in V.fit_features(counts, 2, 0.6, 1.0, "k").collect()}
    assert fit == {"bank": (0, 2)}
    assert V.count_features(df.limit(0), "k", "t").count() == 0


def test_features_combined_shuffles_no_features(spark, tmp_path):
    from folioflow.plans import feature_queries as FQ

    texts = {1: "The bank, the river", 2: "a bank of the river", 3: None, 4: "", 5: "Bank of bank of the west", 6: "no such words"}
    rows = [(k, t, load) for k, t in texts.items() for load in ([1] if k != 5 else [1, 2])]
    spark.createDataFrame(rows, "doc_number long, text string, load_ts long").write.parquet(f"{tmp_path}/df.parquet")
    spark.createDataFrame([(k, "law", 1) for k in (1, 2, 2, 3, 4, 9)], "doc_number long, subject string, rater int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        out = FQ.features_combined(spark, str(tmp_path))
        assert "hashpartitioning(feature#" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = sorted((r.doc_number, r.feature_id, r.n) for r in out.collect())
    # rated and with a text: 1, 2 and 4; a feature in one of them is fitted, in two of them in more than half
    fit = ["bank of", "bank the", "of", "of the", "the bank"]
    held = {1: {"bank the": 1, "the bank": 1}, 2: {"bank of": 1, "of": 1, "of the": 1}, 5: {"bank of": 2, "of": 2, "of the": 1}}
    assert got == sorted([(k, fit.index(f), n) for k, x in held.items() for f, n in x.items()] + [(k, 5, len(t)) for k, t in texts.items() if t is not None])


def test_scaling(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    data = spark.createDataFrame([(0.0, 0.3), (2.0, 7.0), (9.0, None)], "a double, b double")
    out = [tuple(r) for r in V.scale_by(data, V.fit_bounds(train, ["a", "b"]), ["a", "b"]).collect()]
    assert out[:2] == [(0.0, 0.3), (0.5, 1.0)] and out[2][0] == 1.0


def test_reduced_dimensions(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 4, (20, 6))
    bow = spark.createDataFrame([(i, j, int(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "doc_id int, term_id int, n int")
    got = np.array([r.features.toArray() for r in V.reduce_dimensions(bow, 3, unit=False).orderBy("doc_id").collect()])
    along = m @ np.linalg.svd(m.astype(float), full_matrices=False)[2][:3].T
    want = (along - along.min(0)) / (along.max(0) - along.min(0))
    for j in range(3):
        assert np.allclose(got[:, j], want[:, j], atol=1e-6) or np.allclose(got[:, j], 1 - want[:, j], atol=1e-6)


def test_cosines_by_blocks_shuffle_no_pairs(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (60, 300)) * (rng.random((60, 300)) < 2 / np.arange(1, 301) ** 0.5)
    m[:, 0], m[7, 1:] = 1, 0  # a term of all documents weighs nothing; document 7 has no other
    bow = spark.createDataFrame([(i, j, int(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "doc_id long, term_id int, n long").repartition(3, "doc_id")
    f = m * np.log10(60 / np.maximum(1, (m > 0).sum(0)))
    with np.errstate(invalid="ignore"):
        u = f / np.linalg.norm(f, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    for size in (7, 2048):
        out = V.cosines(bow, 0.1000001, 6, size=size)
        assert "hashpartitioning(doc_x" not in out._jdf.queryExecution().toString()
        rows = out.collect()
        got = {(r.doc_x, r.doc_y): r.cosine for r in rows}
        assert len(rows) == len(got) and set(got) == {(x, y) for x in range(60) for y in range(60) if x != y and not c[x, y] <= 0.1}
        assert all(np.isclose(got[p], c[p], atol=1.1e-6, equal_nan=True) for p in got)
        assert np.isnan(got[7, 3]) and np.isnan(got[3, 7])


def test_merges(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "z"), (2, 0, "y")], "k int, p int, v string")
    b = spark.createDataFrame([(1, 0, 5), (2, 0, 6), (2, 1, 7)], "k int, p int, v int")
    got = {r.k: (r.v, r.v_1) for r in C.merge_tables([(a, "join"), (b, "sum")], "k", "p").collect()}
    assert got == {1: ("xz", 5), 2: ("y", 13)}
    with pytest.raises(Exception, match="keys differ"):
        C.merge_tables([(a, "none"), (b.where("k = 1"), "max")], "k", "p").collect()
    both = C.combine_apart([a.select("k"), b.select("k")], "k").orderBy("corpus_no", "k").collect()
    assert [r.k for r in both] == [1, 1, 2, 11, 12, 12]
    routed = C.route(spark.createDataFrame([(1, "The Bank"), (2, "none"), (3, None)], "k int, t string"), "t", ["Bank", "THE"])
    assert sorted((r.k, r.phrase) for r in routed.collect()) == [(1, "Bank"), (1, "THE"), (2, "none"), (3, "none")]


def test_files(spark, tmp_path):
    rows = [(1, 'a "q", b\nc'), (2, ""), (3, None), (4, "plain")]
    df = spark.createDataFrame(rows, "k int, t string")
    assert sorted(tuple(r) for r in S.read_csv(spark, S.write_csv(df, f"{tmp_path}/c"), "k int, t string").collect()) == rows
    lines = spark.createDataFrame([("﻿a, b,,c ",), ("# note",), ("  ",), (",,",)], "value string")
    assert [r.cells for r in S.clean_rows(lines).collect()] == [["a", "b", "c"]]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.txt").write_text("é\nx")
    (tmp_path / "in" / "sub" / "a.txt").write_text("y")
    (tmp_path / "in" / "c.csv").write_text("z")
    got = [(r.number, r.text) for r in S.read_texts(spark, f"{tmp_path}/in").orderBy("number").collect()]
    assert got == [(0, "e x"), (1, "y")]
    assert S.list_files(spark, f"{tmp_path}/in").count() == 1 and S.list_files(spark, f"{tmp_path}/in", ".txt", "sub").count() == 1
    graph = spark.createDataFrame([("a", 'b"<', 0.5)], "x string, y string, overlap double")
    text = [r.line for r in S.graph_lines(graph).orderBy("place", "line").collect()]
    assert len(text) == 6 and '<edge source="a" target="b&quot;&lt;" weight="0.5"/>' in text


def test_vendor_checks(spark):
    df = spark.createDataFrame([("312 words",), ("May 3, 2001 Thursday 9:00 AM Eastern Time",), ("1999",), (" May ",), ("99999",), (None,)], "v string")
    v = F.col("v")
    got = [tuple(r) for r in df.select(vendors.is_word_count(v), vendors.is_date_line(v), vendors.is_int(v), vendors.is_year(v), vendors.is_month(v)).collect()]
    assert got == [(True, False, False, False, False), (False, True, False, False, False), (False, False, True, True, False), (False, False, False, False, True), (False, False, True, False, False), (False,) * 5]
