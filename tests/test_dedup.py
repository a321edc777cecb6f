"""Duplicates of a day and of a file against plain scans."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from folioflow.functions import strings as X
from folioflow.operators import dedup as D


def greedy(rows):
    """key -> duplicate, one day after another."""
    out, kept = {}, {}
    for key, day, title, text in sorted(rows, key=lambda r: r[0]):
        title, text = title or "", text or ""
        if day is None:
            out[key] = False
            continue
        before = kept.setdefault(day, [])
        pairs = [D.matches(title, text, t, x) for t, x in before]
        out[key] = any(p[0] for p in pairs) and any(p[1] for p in pairs)
        if not out[key]:
            before.append((title, text))
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_day_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(4)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for key in range(90):
        day = rng.choice(["2001-01-01", "2001-01-02", None])
        if rows and rng.random() < 0.55:
            _, _, title, text = rng.choice(rows)
            if title and rng.random() < 0.4:
                title = title.replace(rng.choice(title.split()), rng.choice(words), 1)
            if text:
                for _ in range(rng.randrange(4)):
                    at = rng.randrange(len(text))
                    text = text[:at] + rng.choice("xyz") + text[at + rng.randrange(3) :]
        else:
            title, text = " ".join(rng.sample(words, 4)), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))
        text = rng.choice([text] * 9 + [None, ""])
        title = rng.choice([title] * 9 + ["Acme reports earnings for Qtr to June", None])
        rows.append((key, day, title, text))
    df = spark.createDataFrame(rows, "k long, d string, title string, text string")
    got = {r.k: r.duplicate for r in D.duplicates_of_day(df, "k", "d", "title", "text").collect()}
    want = greedy(rows)
    assert got == want and 5 < sum(want.values()) < 85
    assert D.duplicates_of_day(df.limit(0), "k", "d", "title", "text").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd ", min_size=1, max_size=60), st.data())
def test_the_bound_loses_nothing(a, data):
    b = a
    for _ in range(data.draw(st.integers(0, 6))):
        at = data.draw(st.integers(0, len(b)))
        b = b[:at] + data.draw(st.sampled_from(["", "x", "ab"])) + b[at + data.draw(st.integers(0, 1)) :]
    if b and X.ratio(a, b) > D.TEXT_RATIO:
        assert D.bound_holds(a, b)


def test_delivered_again(spark):
    long = "A title that is longer than thirty-two letters, " + "x" * 20
    rows = [
        ("f", "d1", 1, "t", "first text with a head"), ("f", "d1", 2, "u", "text with a"), ("f", "d1", 3, long, "other"), ("f", "d1", 4, long + "y", "more"), ("f", "d1", 5, "v", "other"),
        ("f", "d2", 6, "t", "first text with a head"), ("g", "d1", 7, "t", "other"), ("f", "d1", 8, "w", ""), ("f", "d1", 9, "w", None), ("f", None, 10, "t", "other"), ("f", None, 11, "t", "other"),
    ]
    df = spark.createDataFrame(rows, "path string, day string, seq int, title string, text string")
    got = {r.seq: r.duplicate for r in D.delivered_again(df, "path", "day", "seq", "title", "text").collect()}
    assert [k for k, v in sorted(got.items()) if v] == [2, 4, 5]
