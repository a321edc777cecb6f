"""Text preparation, content filters and cleaning chains, held against results worked by hand."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import cleaning as K, text as X
from folioflow.operators import content as N

CHAINS = {
    "english": ("Dr. Smith paid $15bn at 10:30 am, it's 1/2 & done!", "Dr Smith paid 15 billion dollar at 10 , time val time am , it is half and done . "),
    "français": ("Mr. Dupont dit: l'eau coûte 50% & 1/3.", "monsieur Dupont dit , le eau coûte 50 pour cent et un tiers . "),
    "deutsch": ("Nr. 5 kostet 3/4 vs. 7%", " nummer 5 kostet drei viertel versus 7 prozent "),
    "espanol": ("La Sra. Gil & 2/3", "La Senora Gil y dos tercios "),
    "nederlands": ("Jan's huis ca. 1/2 = 50%", "Jan huis circa de helft is gelijk aan 50 procent "),
    "dansk": ("Nr. 7 & 1/4", " nummer 7 og 1div4 "),
    "italiano": ("Il Sig. Rossi e l'acqua", "Il Signore Rossi e la acqua"),
}


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("language", CHAINS)
def test_chains_by_hand(spark, language):
    text, want = CHAINS[language]
    assert one(spark, text, lambda c: K.clean(c, K.chain(language))) == want


def test_chain_without_commas(spark):
    assert one(spark, "He won't go (far), No. 5 said", lambda c: K.clean(c, K.ENGLISH_NO_COMMAS)) == "He will not go far #5 said"
    assert one(spark, "See www.wm.edu; U.S. rates rose 2.5, OK?", lambda c: K.clean(c, K.ENGLISH_NO_COMMAS)) == "See xxm xxedu . US rates rose 2dot5 okay . "


def test_stop_words_by_hand(spark):
    text = "the bank of his town stood between a river and the hill until it fell"
    assert one(spark, text, X.strip_stop_words) == "bank his town stood between river hill until it fell"
    assert one(spark, text, lambda c: X.strip_stop_words(c, possessives=True, directions=True)) == "bank town stood river hill it fell"
    assert re.sub(" +", " ", one(spark, text, lambda c: X.strip_stop_words(c, True, True, True))) == "bank town stood river hill fell"
    assert one(spark, "it is not well-known", X.join_negations) == "it is not well_known" and one(spark, "not bad not", X.join_negations) == "not_bad not"
    assert one(spark, "not good-will plusx not Bad", X.join_negations) == "not good_will  not Bad"


def test_accents(spark):
    assert one(spark, "Größe naïve é Łódź œuvre Ελλάδα й", X.strip_accents) == "Große naive e Łodz œuvre Ελλαδα и"
    assert one(spark, "Größe naïve Łódź œuvre ø „x“", X.ascii_fold) == "Grosse naive Lodz oeuvre o x"


def test_html():
    page = "<html><head><title>t</title></head><body><p>a &lt; b &amp; c</p><script>x<y</script>5 < 6 ok<br/>end</body></html>"
    assert X.visible(page) == "a < b & c5 < 6 okend"
    assert X.visible("plain 3 < 4") == "plain 3 < 4" and X.visible(None) is None and X.visible("") == ""


def test_split_and_merge(spark):
    text = "aa bbb cccc dd e ffffff g"
    for n in (1, 3, 5, 7, 200):
        parts = X.split_text(text, n)
        assert " ".join(parts) == text and len(parts) <= max(n if n <= 100 else 1, 1)
    assert X.split_text("", 3) == [] and X.split_text("nospaceatall", 3) == ["nospaceatall"]
    rows = [("g", i, "x" * 4) for i in range(7)] + [("h", 1, None), ("h", 2, "y" * 30)]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    got = sorted(tuple(r) for r in X.merge_to_length(df, "g", "i", "t", 9).collect())
    assert got == [("g", 0, [0, 1], "xxxx xxxx "), ("g", 1, [2, 3], "xxxx xxxx "), ("g", 2, [4, 5], "xxxx xxxx "), ("h", 0, [1, 2], " " + "y" * 30 + " ")]
    assert X.merge_to_length(df.limit(0), "g", "i", "t", 9).count() == 0


def test_author_and_words(spark):
    assert X.split_author("JOHN SMITHThe storm came") == ("JOHN SMITH", "The storm came")
    assert X.split_author("ANN LEE and BO RAY a storm") == ("ANN LEE and BO RAY", "a storm")
    assert X.split_author("") == ("", "") and X.split_author(None) is None
    assert one(spark, "one two  three", X.without_last_words) == "one" and one(spark, "a", X.without_last_words) == ""
    assert one(spark, "312 words", X.length_cell) == 312 and one(spark, "none", X.length_cell) == 0 and one(spark, None, X.length_cell) == 0
    assert one(spark, "He left. Why? She ran! a dog. End", X.sentence_points) == "He left . Why . She ran! a dog . End"
    df = spark.createDataFrame([(1, "The bank. BANK banks", ), (2, None)], "k int, t string")
    table = spark.createDataFrame([("bank", "house")], "source string, target string")
    assert {r.k: r.t for r in X.substitute(df, ["k"], "t", table).collect()} == {1: "The house. House banks", 2: None}


def windows(text, search, avoid, distance, before, after):
    """By brute force: one-word phrases only."""
    w = text.lower().split()
    match = lambda word, phrases: any(re.fullmatch(p.replace("*", "[0-9A-Za-z_-]*") + "[.,;:!?]?", word) for p in phrases)
    bad = [i for i, x in enumerate(w) if match(x, avoid)]
    found = [i for i, x in enumerate(w) if match(x, search) and not any(abs(i - b) <= distance for b in bad)]
    kept = [i for i in range(len(w)) if any(f - before <= i <= f + after for f in found)]
    out = ""
    for n, i in enumerate(kept):
        out += ("" if not n else " " if kept[n - 1] == i - 1 else " ... ") + w[i]
    return (out, len(found)) if found else None


def test_content_windows(spark):
    texts = ["a bank, b c d e f bank g river h banks", "none here", "", None, "bank", "river bank", "x bank. y Bank z"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for distance, before, after in ((0, 1, 1), (2, 0, 2), (1, 3, 0)):
        got = {r.k: (r.filtered, r.n_matches) for r in N.filter_by_content(df, "t", ["bank*"], ["river"], distance, before, after).collect()}
        want = {i: x for i, t in enumerate(texts) if t and (x := windows(t, ["bank*"], ["river"], distance, before, after))}
        assert got == want
    whole = {r.k: r.filtered for r in N.filter_by_content(df, "t", ["bank"], empty=True).collect()}
    assert whole[4] == "bank" and whole[1] == "" and whole[3] == "" and len(whole) == len(texts)
    many = {r.k: (r.x, r.y, r.n_matches) for r in N.filter_by_many(df, "t", {"x": (["bank"], []), "y": (["river bank", "b c"], [])}).collect()}
    assert many == {0: (2, 1, 3), 4: (1, 0, 1), 5: (1, 1, 2), 6: (2, 0, 2)}
    assert {r.k for r in N.extract_by_content(df, "k", "t", ["bank"], ["river bank"]).collect()} == {0, 4, 6}


@pytest.mark.parametrize(("mark", "want"), [
    ("Section B; Part 2; Page 14; Column 3", (2, 2, 14, 3, False, False, False)), ("Sports; Pg. B4", (2, 0, 4, 0, False, False, False)), ("A12", (1, 0, 12, 0, False, False, False)),
    ("News, 7", (0, 0, 7, 0, False, False, False)), ("Arts", (0, 0, 0, 0, False, False, True)), ("Page 3; Page 5", (0, 0, 3, 0, True, False, False)), ("Section C; Page B4", (3, 0, 4, 0, False, True, False)),
    ("", (0, 0, 0, 0, False, False, True)),
])
def test_page_fields(spark, mark, want):
    from folioflow.functions import pages

    assert tuple(one(spark, mark, pages.fields)) == want


def test_published_stems():
    from folioflow.functions.porter import stem

    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer adjustment adjust effective effect probate probat rate rate controll control roll roll"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_dated_lines(spark):
    lines = ["1 of 3 DOCUMENTS", "", "Paper", "Title", "text", "2 of 3 DOCUMENTS", "", "Paper", "Title", "3 of 3 DOCUMENTS", "x"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "path string, n int, line string")
    got = [r.line for r in X.dated_lines(df, "n", "line", "May 3, 2001", 2, 3).orderBy("n", "rank").collect()]
    assert got == [*lines[:8], "", "May 3, 2001", *lines[8:]]


def test_published_stems_of_the_second_form():
    from folioflow.functions.porter2 import stem

    pairs = (
        "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol console consol "
        "consoled consol consolingly consol knack knack knackeries knackeri knacks knack knave knave knaves knave knavish knavish kneaded knead kneel kneel knees knee knell knell knightly knight knights knight knives knive "
        "knotted knot knotty knotti skies sky dying die news news succeed succeed running run hoping hope hopping hop cries cri ties tie gas gas this this gaps gap kiwis kiwi luxuriated luxuri generate generat generous generous "
        "by by say say agreed agre conditional condit vietnamization vietnam sensational sensat happily happili controlling control"
    ).split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_stemmed_texts(spark):
    from folioflow.functions.porter import stem

    assert one(spark, "ponies were hopping. it is not relational", lambda c: X.stem_texts(stem)(c)) == "poni were hop . it is not relat"
    assert one(spark, "it is not relational", lambda c: X.stem_texts(stem, True)(c)) == "it is not_relat" and one(spark, None, lambda c: X.stem_texts(stem)(c)) is None
