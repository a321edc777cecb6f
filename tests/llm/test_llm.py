import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from folioflow.llm import leakage, lookalike, mixing, neardup, relevance, sentences, subjects, termfreq, truncation


def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(("text", "want"), [
    ('"We have a bank. It needs it!" Ann told the city. Mr. J. Smith left for the U.S. He ran.', ['"We have a bank. It needs it!" Ann told the city.', "Mr. J. Smith left for the U.S.", "He ran."]),
    ("They ran again... and then (see p. 15) it rose 5.70 percent. At 4:09 p.m. the bus left.", ["They ran again... and then (see p. 15) it rose 5.70 percent.", "At 4:09 p.m. the bus left."]),
    ("(The storm came. It left.) Why? Go!  Yes", ["(The storm came. It left.)", "Why?", "Go!", "Yes"]),
    ("“部长是清楚的。没有别的。”彧骞说。为什么？约2人！", ["“部长是清楚的。没有别的。”彧骞说。", "为什么？", "约2人！"]),
    ("„Bank ist alt. So bleibt es“, sagte sie. Am 6. Oktober kam z. B. Klinik. Nr. 3 war da.", ["„Bank ist alt. So bleibt es“, sagte sie.", "Am 6. Oktober kam z. B. Klinik.", "Nr. 3 war da."]),
    ("ในปีพ.ศ.2535มณีเห็นธนาคาร ผู้คน12คนเห็นครู\nมณีชนะ", ["ในปีพ.ศ.2535มณีเห็นธนาคาร", "ผู้คน12คนเห็นครู", "มณีชนะ"]),
    ("बैंक नया है। डॉ. रवि ने कहा। क्या?", ["बैंक नया है।", "डॉ. रवि ने कहा।", "क्या?"]),
    ("En EE. UU. el juez vino. El Sr. Paz salió. ¿Por qué? ¡No!", ["En EE. UU. el juez vino.", "El Sr. Paz salió.", "¿Por qué?", "¡No!"]),
    ("One line\nanother \"open. line\nnext. End", ["One line", "another \"open. line", "next.", "End"]),
    ("", []), ("  \n ", []), ("...", []),
])
def test_sentences(text, want):
    assert cut(text) == want


PIECES = ["Hello", "x", "Mr.", "U.S.", '"', "“", "”", "(", ")", ".", "!", "?", "...", " ", "  ", "\n", "«", "»", "的。", "ไทย", "12", "said", "„", "』", "'", "He", "—", "#"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=50), st.lists(st.booleans(), min_size=50, max_size=50), st.sampled_from([1, 2, 3, 5, 8, 13, 40]))
def test_chunks_give_what_one_run_gives(pieces, blanks, size):
    text = "".join(p + " " * b for p, b in zip(pieces, blanks))
    cuts = [(text[max(0, k - sentences.CONTEXT) : k + size + sentences.CONTEXT], min(sentences.CONTEXT, k), min(size, len(text) - k)) for k in range(0, len(text), size)]
    states = sentences.prefix_states(np.array([sentences.transition(p, a, a + n) for p, a, n in cuts]).reshape(-1, 2 * sentences.STATES))
    stretches = []
    for k, ((piece, lead, n), state) in enumerate(zip(cuts, states)):
        places, _ = sentences.cuts(piece, int(state), lead, lead + n)
        stretches += sentences.parts(piece, places, lead, lead + n, k * size - lead)
    assert sentences.joined(stretches) == sentences.sentence_spans(text)


def test_long_texts_edge(spark):
    head = ("word " * 20000)[: sentences.CHUNK - 15] + ". x. Hello "
    text = head + '"Yes." Bob he said it was. Next one.'
    df = spark.createDataFrame([(1, text), (1, text)], "doc_number long, text string")
    got = [tuple(r)[1:] for r in sentences.sentences(df, ["doc_number"]).orderBy("start_char", "end_char").collect()]
    assert got == sorted(2 * sentences.sentence_spans(text))


def test_long_texts(spark):
    text = " ".join(f'"Word {i}. Two!" Ann said to {i}. Next (see p. {i}) one.' for i in range(300))
    df = spark.createDataFrame([(1, text), (2, "A b. C d."), (3, None), (4, "")], "doc_number long, text string")
    short = {tuple(r) for r in sentences.sentences(df, ["doc_number"]).collect()}
    assert short == {tuple(r) for r in sentences.sentences(df, ["doc_number"], chunk=700).collect()}
    assert {r[0] for r in short} == {1, 2} and sentences.sentences(df.limit(0), ["doc_number"]).count() == 0


def test_canonical():
    c = lookalike.canonical
    assert c("ｓａｉｄ ﬁne café a​b x y") == "said fine café ab x y"
    assert c("gеnоme рart tοday") == "genome part today"
    assert c("Москва “quoted” 你好，世界") == "Москва “quoted” 你好，世界" and c("") == ""
    assert lookalike.unified("Москва “q” 你好，世界 naïve น้ำ")[1] == []
    assert lookalike.unified("ａ1 ﬁ é ­ 　 gеn")[1] == ["full_width", "ligature", "accent", "invisible", "space", "mixed_script"]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_canonical_settles(text):
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once or unicodedata.normalize("NFC", lookalike.canonical(once)) == lookalike.canonical(once)


def test_mixed_words_come_from_the_lattice(monkeypatch):
    assert lookalike.unified("gеn")[1] == ["mixed_script"] and lookalike.unified("абвwqz")[1] == ["mixed_script"]
    monkeypatch.setattr(lookalike, "resolve", lambda word, scores: (word, False))
    assert lookalike.unified("gеn")[1] == []


def test_unify_nulls(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "аb", "k")], "doc_id int, text string, kinds string")
    assert [(r.text_norm, r.kinds) for r in lookalike.unify(df).orderBy("doc_id").collect()] == [(None, None), ("", []), ("ab", ["mixed_script"])]


def test_term_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, *range(2, 40)]), rng.randrange(4), rng.randrange(9), None) for _ in range(3000)]
    rows = [(d, s, t, f"w{(d * 7 + s * 3 + t) % 30}") for d, s, t, _ in rows] + [(None, 0, 0, "x"), (99, 0, 0, None)]
    rows += [(1, 0, 0, "w7")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, sentence_num int, token_num int, term_str string").repartition(6)
    places = {(d, s, t): w for d, s, t, w in rows if d is not None}
    want = {}
    for (d, _, _), w in places.items():
        want.setdefault(w, []).append(d)
    got = {r.term: (r.occurrences, r.records) for r in termfreq.term_counts(df).collect()}
    assert got.pop(None)[1] == len({d for d, *_ in places})
    want.pop(None)
    assert got == {w: (len(x), len(set(x))) for w, x in want.items()}
    assert termfreq.term_counts(df.limit(0)).count() == 0


def test_relevance(spark):
    rows = [(d, 0, t, (d * t) % 7) for d in range(1, 6) for t in range(20)] + [(None, 0, 0, 1), (1, 1, 1, None), (1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, sentence_num int, token_num int, term_id int")
    docs = {d: [(d * t) % 7 for t in range(20)] for d in range(1, 6)}
    for r in relevance.relevance(df).collect():
        tf = docs[r.doc_id].count(r.term_id)
        n = sum(r.term_id in x for x in docs.values())
        score = math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2)
        assert (r.tf, r.df, r.length) == (tf, n, 20) and abs(r.score - score) < 1e-9
    assert relevance.relevance(df.limit(0)).count() == 0


def test_similar_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rows = [(i, None if i % 3 else "a title", " ".join(t)) for i, t in enumerate(texts)] + [(900, None, None), (901, "", ""), (902, None, "two words"), (903, None, rows_text := "x y z"), (904, None, rows_text)]
    df = spark.createDataFrame(rows, "doc_number long, title string, text string")
    sets = {}
    for i, title, text in rows:
        if text is not None:
            w = re.findall(r"[^\W_]+", ((title or "") + " " + text).lower())
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = {tuple(r) for r in neardup.similar_pairs(df).collect()}
    assert got == want and (903, 904) in got
    groups = {r.doc_number: r.group_id for r in neardup.similar_groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in want)
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 101), (200, 201)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 105, 200, 201, 300]], "c long")
    got = {r.c: r.root for r in neardup.components(nodes, spark.createDataFrame(links, "ca long, cb long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100, 200: 200, 201: 200, 300: 300}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=10), st.lists(st.sampled_from("abc"), max_size=14))
def test_myers(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    assert leakage.myers(pattern, text) == min(row)


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [
        (1, "Zero. ONE two, three four five six​ seven eight nine ten eleven twelve end"), (2, "two three four five six seven XX nine ten eleven twelve thirteen"),
        (3, "one two three four five six"), (4, None), (5, ""), (6, "twо three fοur ｆｉｖｅ six seven eight nine ten eleven twelve thirteen"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    assert {(r.item_id, r.doc_id, r.changes) for r in leakage.find_leaks(d, i).collect()} == {(7, 1, 0), (7, 6, 0), (7, 2, 1)}
    assert {(r.item_id, r.doc_id) for r in leakage.find_leaks(d, i, budget=0).collect()} == {(7, 1), (7, 6)}
    assert leakage.find_leaks(d, i.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), i).count() == 0


def test_leaks_come_from_the_distance(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    d, i = spark.createDataFrame([(1, "before " + text + " behind")], "doc_id long, text string"), spark.createDataFrame([(7, text)], "item_id long, text string")
    assert leakage.find_leaks(d, i, budget=0).count() == 1
    words = list(range(20))
    assert leakage.least_changes(words[:18], 6, [90, *words, 91], 7, 12, 6, 0) == 0
    monkeypatch.setattr(leakage, "myers", lambda pattern, text: 9)
    assert leakage.least_changes(words[:18], 6, [90, *words, 91], 7, 12, 6, 0) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=12, max_size=24), st.lists(st.sampled_from("abcde"), max_size=40), st.integers(0, 1))
def test_leaks_by_brute_force(item, doc, budget):
    run, width = 6, 7 // (budget + 2)
    kind = {"item": pa.array([7]), "t": pa.array([" ".join(item)])}
    pieces = next(leakage._pieces(run, width)(iter([pa.RecordBatch.from_pydict(kind)])))
    bits = next(leakage._marked(iter([pieces]))).column(0)[0].as_py()
    hits = next(leakage._hits(run, width, budget, zlib.compress(bits))(iter([pa.RecordBatch.from_pydict({"doc": pa.array([1]), "t": pa.array([" ".join(doc)])})])))
    found = any(
        x["h"] == y["h"]
        and leakage.may_hold(pa.array([y["words"]], pa.list_(pa.int64())), pa.array([x["near"]], pa.list_(pa.int64())), run, budget)[0]
        and leakage.least_changes(y["words"], y["off"], x["near"], x["place"], run, width, budget) <= budget for x in hits.to_pylist() for y in pieces.to_pylist()
    )
    assert found == any(leakage.myers(item[a : a + run], doc) <= budget for a in range(len(item) - run + 1))


def test_flow():
    flow, missing = mixing.allot({("a",): 10.0, ("b",): 5.0, ("a", "b"): 4.0}, {"a": 12.0, "b": 20.0, "c": 1.0}, {"a": 2, "b": 3, "c": 2})
    assert missing["a"] == 0 and missing["c"] == 1 and missing["b"] == 0
    assert sum(v for (p, _), v in flow.items() if p == ("a", "b")) <= 3 * 4


def least_cost(patterns, quotas, repeats):
    """(most flow, least cost) by cheapest paths, one unit at a time."""
    arcs = {}

    def arc(a, b, room, cost):
        arcs[a, b, cost] = [room, cost]
        arcs.setdefault((b, a, -cost), [0, -cost])

    for p, size in patterns.items():
        for lap in range(max((repeats[s] for s in p if s in quotas), default=0)):
            arc("start", ("lap", p, lap), size, lap)
            arc(("lap", p, lap), p, size, 0)
        for s in p:
            if s in quotas and repeats[s]:
                arc(p, s, size * repeats[s], 0)
    for s, q in quotas.items():
        arc(s, "end", q, 0)
    flow = cost = 0
    while True:
        far, via = {"start": 0}, {}
        for _ in range(len(arcs)):
            changed = False
            for (a, b, c), (room, _) in arcs.items():
                if room > 0 and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], via[b], changed = far[a] + c, (a, b, c), True
            if not changed:
                break
        if "end" not in far:
            return flow, cost
        x = "end"
        while x != "start":
            a, b, c = via[x]
            arcs[a, b, c][0] -= 1
            arcs[b, a, -c][0] += 1
            x = a
        flow, cost = flow + 1, cost + far["end"]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda x: tuple(sorted(x))), st.integers(1, 4), max_size=4), st.lists(st.integers(0, 9), min_size=3, max_size=3), st.lists(st.integers(0, 3), min_size=3, max_size=3))
def test_laps_give_the_least_cost(patterns, quotas, repeats):
    quotas, repeats = dict(zip("abc", quotas)), dict(zip("abc", repeats))
    flow, missing = mixing.allot({p: float(n) for p, n in patterns.items()}, {s: float(q) for s, q in quotas.items()}, repeats)
    taken = {}
    for (p, _), amount in flow.items():
        taken[p] = taken.get(p, 0.0) + amount
    cost = sum(sum(lap * min(patterns[p], max(0.0, n - lap * patterns[p])) for lap in range(4)) for p, n in taken.items())
    most, least = least_cost(patterns, quotas, repeats)
    assert abs(sum(flow.values()) - most) < 1e-6 and abs(cost - least) < 1e-6
    assert abs(sum(missing.values()) - (sum(quotas.values()) - most)) < 1e-6


def test_draw(spark):
    rng = random.Random(2)
    docs = [(i, f"text number {i} " + "word " * rng.randrange(30), rng.choice(["a", "a", "a", "b", None])) for i in range(400)] + [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.5, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    texts = mixing.memberships(mixing.count_tokens(df)).cache()
    total = sum(r.n_tokens for r in texts.collect())
    drawn = mixing.draw(texts, targets).collect()
    size = {s: sum(r.copies * r.n_tokens for r in drawn if r.source == s) for s in ("a", "b")}
    assert abs(size["a"] - 0.4 * total) < 60 and size["b"] <= 0.5 * total + 60
    assert max(r.copies for r in drawn if r.source == "a") == 1 and max(r.copies for r in drawn) <= 3
    assert sorted(drawn) == sorted(mixing.draw(texts, targets).collect())


@pytest.mark.parametrize(("text", "cut"), [
    ("It rose. The bank of the ci", True), ("It rose.\n\nBy the Fumebert desk", False), ("It rose.\n\n(END)", False), ("It rose. \"We have a bank.", True), ("He ran. The c...", True),
    ("He ran. Mr", True), ("He ran [...]", True), ("He ran. (even the game).", False), ("他跑了。又提", True), ("他跑了。", False), ("He ran.\n\n-- A. Smith, staff writer", False), ("texte nouv�", True),
])
def test_endings(spark, text, cut):
    df = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, None, "  ")], "doc_number long, source string, text string")
    rows = truncation.find_cuts(df).collect()
    assert [(r.doc_number, r.cut) for r in rows] == [(1, cut)]


def test_limits(spark):
    rng = random.Random(4)
    lengths = [("a", rng.randrange(200, 900)) for _ in range(3000)] + [("a", 512)] * 60 + [("b", rng.randrange(200, 900)) for _ in range(1000)]
    got = {(r.source, r.length) for r in truncation.length_hazards(spark.createDataFrame(lengths, "source string, length int")).where("limit").collect()}
    assert got == {("a", 512)}


def test_subjects(spark):
    rng = random.Random(6)
    seeds = {s: [f"{s}{c}" for c in ("alpha", "beta", "gamma", "delta")] for s in ("law", "sport", "arts", "health", "travel", "money", "school")}
    extra = {s: [f"{s}omega", f"{s}sigma"] for s in seeds}
    rows, truth = [], {}
    for i in range(600):
        s = rng.choice(list(seeds))
        truth[i] = s
        sentence = lambda: f"The {rng.choice(seeds[s] + extra[s])} of the city saw a {rng.choice(extra[s])} today."  # noqa: B023, E731
        rows.append((i, None, " ".join(sentence() for _ in range(6)) + " It was so."))
    rows += [(900, "x", None), (901, "x", ""), (902, "x", "Nothing here.")]
    df = spark.createDataFrame(rows, "doc_number long, section string, text string")
    keys = spark.createDataFrame([(i, 0.1, " ".join(w), s) for i, (s, w) in enumerate(seeds.items())], "topic int, alpha double, words string, subject string")
    labels = spark.createDataFrame([(0, truth[0], 1), (1, truth[1], 1)], "doc_number long, subject string, rater int")
    got = {(r.doc_number, r.subject) for r in subjects.subject_shares(df, keys, labels).collect()}
    assert got == set(truth.items())
    assert subjects.subject_shares(df.limit(0), keys, labels).count() == 0
