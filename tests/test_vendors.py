from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioflow.functions.porter import stem
from folioflow.sources import vendors as V

LEXIS = """
                    1 of 2 DOCUMENTS

The Daily Wire

May 11, 2001 Friday

The bank rose

BYLINE: Ann Lee

SECTION: Economy; Pg. 4

The bank rose again. It was
a good day.

Copyright 2001 The Daily Wire

                    2 of 2 DOCUMENTS

The Daily Wire

11 May 2001

The bank rose

The bank rose again. It was a good day.

Copyright 2001
"""
PROQUEST = f"""Title: First [Late edition]

Publication title: The Post

Publication date: Jul 4, 1999

Publication date: May 4, 2000

Full text: One text.

https://search.example.com/docview/12345
{"_" * 60}
Title: Second

Full text: Two text.
{"_" * 60}
end
"""
NEXIS = "The title\nThe Gazette\nJune 3, 2000 Saturday\n\nLength: 12 words\n\nBody\n\nA text here.\n\nEnd of Document\n"
FACTIVA = "Economy -- Bank falls\nBy Ann Lee\n1,204 words\n3 June 2000\nThe Wire\n(c) 2000 The Wire\nThe bank fell.\nDocument wire000020010803dw63000b1\n"


def rows(spark, name, dump, fill=False):
    df = spark.createDataFrame([(f"/x/{name}/a.txt", dump)], "path string, value string")
    return V.articles(V.parse(df), fill).orderBy("seq").collect()


def test_lexis(spark):
    a, b = rows(spark, "LN", LEXIS)
    assert (a.publication, a.title, str(a.published), a.weekday, a.meta["SECTION"]) == ("The Daily Wire", "The bank rose", "2001-05-11", "Friday", "Economy; Pg. 4")
    assert a.text == "The bank rose again. It was a good day." and not a.duplicate and b.duplicate


def test_proquest(spark):
    a, b = rows(spark, "ProQuest", PROQUEST.replace("Jul 4", "July 4"), fill=True)
    assert (a.vendor_id, a.edition, a.text, str(a.published)) == ("12345", "Late edition", "One text.", "1999-07-04")
    assert (b.publication, str(b.published), b.text) == ("The Post", "1999-07-04", "Two text.")


def test_others(spark):
    (a,) = rows(spark, "NexisUni", NEXIS)
    assert (a.title, a.publication, str(a.published), a.text, a.meta["Length"]) == ("The title", "The Gazette", "2000-06-03", "A text here.", "12 words")
    (b,) = rows(spark, "Factiva", FACTIVA)
    assert (b.title, b.meta["SECTION"], b.meta["AUTHOR"], b.publication, b.text) == ("Bank falls", "Economy", "Ann Lee", "The Wire", "The bank fell.")
    assert rows(spark, "Other", NEXIS) == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ", max_size=900), st.integers(101, 300))
def test_split_joins(text, size):
    parts = V.split_text(text, size)
    assert "".join(parts) == text and all(len(p) <= size + 101 for p in parts)


def test_stems():
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "electrical", "controlling")] == ["caress", "poni", "relat", "hop", "agre", "electr", "control"]


def test_running_numbers_over_all_files(spark):
    rows = [("b/LN/x.txt", 0), ("a/LN/y.txt", 1), ("a/LN/y.txt", 0), ("b/LN/x.txt", 11), ("b/LN/x.txt", 2)]
    df = spark.createDataFrame(rows, "path string, seq int")
    got = {(r.path, r.seq): r.doc_nr for r in V.numbered(df).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(rows))}
    assert V.numbered(df.limit(0)).count() == 0


def test_sources_left_out(spark):
    df = spark.createDataFrame([("New York Times",), ("Daily Blogs",), ("x.com",), ("Law Review",), ("Elsewhere",), (None,)], "s string")
    got = [tuple(r) for r in df.select(V.skipped(F.col("s")), V.skipped(F.col("s"), V.US_SOURCES)).collect()]
    assert got == [(False, False), (True, True), (True, True), (True, True), (False, True), (False, False)]


def test_dates_in_seven_languages(spark):
    lines = ["May 11, 2001 Friday", "le 3 août 1999", "11. März 2000", "3 de mayo de 2001", "4 maart 2002", "1. maj 1999", "2 febbraio 2000", "1er juin 2001", "Marchall 2001", None, "31 febbraio 2000"]
    want = ["2001-05-11", "1999-08-03", "2000-03-11", "2001-05-03", "2002-03-04", "1999-05-01", "2000-02-02", "2001-06-01", None, None, None]
    parsed = spark.createDataFrame([("p", i, None, "The Post", x, "title", None, f"text {i}", None) for i, x in enumerate(lines)], V.SCHEMA)
    got = {r.seq: r.published and str(r.published) for r in V.articles(parsed).collect()}
    assert [got[i] for i in range(len(lines))] == want
