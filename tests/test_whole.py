"""Queries over all rows of small tables, held against plain Python."""

import datetime
import unicodedata

from folioflow.operators import signals as G
from folioflow.plans import corpus_queries as CQ, signal_queries as SQ, vector_queries as VQ

TOKEN = "section string, doc_id long, sentence_num int, token_num int, token_str string, term_str string, term_id int, punc int, num int"


def write(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_length_first_word_of_every_text(spark, tmp_path):
    texts = ["one line", "first\nsecond line", "\n\t tabbed\tword", "no break", "wide　blank", "  \n", "", "single", None]
    d = write(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.first_word for r in CQ.length_first_word(spark, d).collect()}
    assert got == {i: (t.split() or [""])[0] for i, t in enumerate(texts) if t is not None}


def test_bad_date_counts_null_and_points(spark, tmp_path):
    rows = [("2001", "3"), (" 2002", " 4 "), (None, "5"), ("2001.0", "6"), ("6,165", None), ("B7C", "x"), ("", "1.0"), ("99999999999", "7")]
    d = write(spark, tmp_path, "df", rows, "year string, num_day string")
    assert tuple(CQ.bad_date_counts(spark, d).first()) == (6, 3)


def tokens(spark, d, articles, days):
    """Tables token and doc; articles: doc_id to its sentences, days: doc_id to year, month and day."""
    vocab = sorted({w for x in articles.values() for sent in x for w in sent.split()})
    rows = [("A", i, j, k, w, w, vocab.index(w), 0, 0) for i, x in articles.items() for j, sent in enumerate(x) for k, w in enumerate(sent.split())]
    write(spark, d, "token", rows + [("A", next(iter(articles)), 0, 99, ".", None, None, 1, 0)], TOKEN)
    return write(spark, d, "doc", [(i, *days[i], "A") for i in articles], "doc_id long, year int, month int, day int, section string")


def test_month_strings_hold_every_sentence(spark, tmp_path):
    articles = {9: ["a b", "c d e"], 3: ["f", "g", "h i"], 2 * SQ.PART_IDS: ["j k"], 10: ["l", "m"]}
    days = {9: (2001, 5, 1), 3: (2001, 5, 30), 2 * SQ.PART_IDS: (2001, 5, 2), 10: (2002, 1, 1)}
    got = SQ.month_strings(spark, tokens(spark, tmp_path, articles, days)).orderBy("part_no").collect()
    whole = {m: " ".join(r.month_str for r in got if (r.year, r.month) == m) for m in {(r.year, r.month) for r in got}}
    assert whole == {(2001, 5): "f g h i a b c d e j k", (2002, 1): "l m"} and len(got) == 3


def plain_tokens(text):
    out, run = [], ""
    for c in text + " ":
        if c == "_" or unicodedata.category(c)[0] in "LMN":
            run += c
            continue
        out += [run] * bool(run) + [c] * (not c.isspace())
        run = ""
    return out


def test_token_table_of_every_script(spark, tmp_path):
    texts = ["plain words, here.", "typographic \u201cquotes\u201d \u2013 dashes\u2026", "no\u00a0break\u2009thin\u3000wide", "Größe: 3\u00a0km", "\u0939\u093f\u0928\u094d\u0926\u0940 \u092a\u093e\u0920\u0964",
        "\u0440\u0443\u0441\u0441\u043a\u0438\u0439, \u0442\u0435\u043a\u0441\u0442", "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22", "\u4e2d\u6587\u3002\u6587\u672c", "\U0001d4d0 emoji \U0001f600", ""]
    d = write(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in VQ.token_table(spark, d).collect())
    assert got == [(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(plain_tokens(t))]


def test_networks_take_every_term_of_the_filtered_vocabulary(spark, tmp_path):
    import numpy as np

    names = [f"w{i:02}" for i in range(14)]
    articles = {i: [" ".join(w for k, w in enumerate(names) if (i * 7 + k * 3) % 5 < 2)] for i in range(1, 30)}
    days = {i: (1999 + i % 3, 1 + i % 12, 1 + i % 28) for i in articles}
    tokens(spark, tmp_path, articles, days)
    # 14 kept terms above 250 rare ones: the 0.94 quantile falls between
    vocab = [(w, 100 + k, 0) for k, w in enumerate(names)] + [(f"rare{i}", 1, 0) for i in range(250)] + [("the", 999, 1)]
    d = write(spark, tmp_path, "vocab", vocab, "term_str string, n long, stop int")
    at = {w: sorted((datetime.date(*days[i]) - datetime.date(1999, 1, 1)).days for i in articles if w in articles[i][0].split()) for w in names}
    parts = SQ.term_offsets(spark, d).orderBy("part_no").collect()
    assert {w: [p for r in parts if r.term_str == w for p in r.places] for w in names} == at
    x = np.linspace(0, 1500, 1000)
    m = {w: sum(np.exp(-(((x - p) / 60) ** 2) / 2) for p in at[w]) / (len(at[w]) * 60 * np.sqrt(2 * np.pi)) * 1.5 for w in names}
    got = {(r.x, r.y): (r.overlap, r.corr) for r in G.overlaps(SQ.curves(spark, d), "term_str", SQ.SAMPLES).collect()}
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), pair in got.items():
        assert np.allclose(pair, (np.trapezoid(np.minimum(m[a], m[b])), np.corrcoef(m[a], m[b])[0, 1]), atol=1e-6)
    near = SQ.friends(spark, d).groupBy("x").count().collect()
    assert {(r.x, r["count"]) for r in near} == {(w, 10) for w in names} and SQ.top_edges(spark, d).count() == 91


def test_doc_cosine_of_every_article(spark, tmp_path):
    import numpy as np

    # ids of which few are divisible by 50; w0 stands in every article and weighs nothing
    articles = {i: [" ".join(["w0"] + [f"w{k}" for k in range(1, 15) for _ in range((i * 7 + k * 5) % 6 - 3)])] for i in [*range(1, 30), 50]}
    d = tokens(spark, tmp_path, articles, dict.fromkeys(articles, (2001, 1, 1)))
    bags = {i: [x[0].split().count(f"w{k}") for k in range(15)] for i, x in articles.items()}
    n = np.array(list(bags.values()), dtype=float)
    f = n / n.sum(1, keepdims=True) * np.log10(len(n) / np.maximum(1, (n > 0).sum(0)))
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    want = {(x, y): c for x, row in zip(bags, u @ u.T) for y, c in zip(bags, row) if x != y and c > 0.1000001}
    got = {(r.doc_x, r.doc_y): r.cosine for r in VQ.doc_cosine(spark, d).collect()}
    assert set(got) == set(want) and any(x % 50 for x, _ in want)
    assert all(abs(got[p] - c) < 1e-6 for p, c in want.items())
