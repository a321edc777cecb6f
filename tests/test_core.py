import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioflow.functions import strings as X
from folioflow.operators import corpus as C, signals as G, vectors as V

word = st.text(alphabet="abc", max_size=9)


@settings(max_examples=200, deadline=None)
@given(word, word)
def test_measures(a, b):
    assert 0 <= X.ratio(a, b) <= 1 and X.ratio(a, b) == X.ratio(b, a) and X.distance(a, b) == X.distance(b, a)
    assert X.apply_script(X.edit_script(a, b), a, b) == b
    assert X.apply_script(X.inverse(X.edit_script(a, b)), b, a) == a
    assert len(X.edit_script(a, b)) == X.distance(a, b)
    assert sum(n for *_, n in X.matching_blocks(a, b)) <= min(len(a), len(b))
    assert X.ratio(a, b) <= X.quick_ratio_bound(a, b)


@settings(max_examples=200, deadline=None)
@given(word, word, st.integers(0, 9))
def test_blocks_and_subtraction(a, b, n):
    assert "".join(a[i:j] if op == "equal" else b[k:m] for op, i, j, k, m in X.opcodes(a, b)) == b
    ops = X.edit_script(a, b)
    middle = X.apply_script(ops[:n], a, b)
    assert X.apply_script(X.subtract(ops, ops[:n]), middle, b) == b


def test_published_values():
    spellings = ["Levnhtein", "Leveshein", "Leenshten", "Leveshtei", "Lenshtein", "Lvenstein", "Levenhtin", "evenshtei"]
    assert X.greedy_median(spellings) == "Levenshtein" and X.improve_median("spam", spellings) == "enhtein"
    assert X.edit_script("spam", "park") == [("delete", 0, 0), ("insert", 3, 2), ("replace", 3, 3)]
    assert X.matching_blocks("spam", "park") == [(1, 0, 2), (4, 4, 0)]
    assert round(X.jaro("Thorkel", "Thorgier"), 6) == 0.779762 and X.jaro_winkler("Thorkel", "Thorgier", 0.25) == 1.0


def test_renumber_and_offsets(spark):
    ids = random.Random(3).sample(range(10000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = {r.id: r.new_id for r in C.renumber(df, "id").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(ids))}
    assert C.renumber(df.limit(0), "id").count() == 0
    assert sorted(r.id for r in C.combine([df.where("id < 5000"), df.where("id < 5000")], "id", 5000).collect()) == sorted([i for i in ids if i < 5000] + [i + 5000 for i in ids if i < 5000])


def test_first_wins_and_fill(spark):
    a, b = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, "b"), (2, "b")], "id int, x string")
    assert {tuple(r) for r in C.first_wins([a, b], "id").collect()} == {(1, "a"), (2, "b")}
    t = spark.createDataFrame([("g", 1, None), ("g", 2, "x"), ("g", 3, None), ("h", 1, None)], "g string, i int, v string")
    assert [r.v for r in C.fill_forward(t, ["g"], ["i"], ["v"]).orderBy("g", "i").collect()] == [None, "x", "x", None]


def test_fill_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([None, None, None, f"{g}{i}"]), rng.choice([None, i])) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v string, w int").repartition(7)
    want, last = {}, {}
    for g, i, v, w in rows:
        last[g] = (v or last.get(g, (None, None))[0], w if w is not None else last.get(g, (None, None))[1])
        want[g, i] = last[g]
    assert {(r.g, r.i): (r.v, r.w) for r in C.fill_forward(df, ["g"], ["i"], ["v", "w"]).collect()} == want


def test_triangle_widths(spark):
    rows = [(i, float((i * 7) % 11)) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, v double")
    for width in (3, 5, 7, 9):
        h = (width + 1) // 2
        got = {r.i: r.rolling_sum for r in G.rolling_triangle(df, "i", "v", width).collect()}
        for i, _ in rows:
            near = [(j, v) for j, v in rows if abs(j - i) < h]
            want = sum(v * (h - abs(j - i)) / h for j, v in near) if len(near) == width else None
            assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9)


def test_histogram_and_shares(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    assert {r.bin: r.n for r in G.histogram(df, "v", 10).collect()} == {i: 10 for i in range(10)}
    bow = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (2, 1, 2)], "doc_id int, term_id int, n long")
    assert all(abs(r.s - 1) < 1e-12 for r in V.tf_idf(bow).groupBy("doc_id").agg(F.sum("tf").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-12 for r in V.tf_idf_unit(bow).groupBy("doc_id").agg(F.sum(F.col("f") * F.col("f")).alias("s")).collect())


def test_entry_has_queries():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "p7_found" in queries and len(queries) > 90
