"""The blocked product, in process: hot columns split into cells lose and repeat nothing."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import neardup


def pairs_met(texts, threshold):
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["_0"])
    levels = np.zeros(1 << neardup.SKETCH_BITS, dtype=np.int64)
    for out in neardup._sketch(3)(iter([batch])):
        for block, *packed in zip(*[out.column(i).to_pylist() for i in range(4)]):
            levels[block * neardup._BLOCK : (block + 1) * neardup._BLOCK] += neardup._unsqueeze(*packed)
    rows = [np.concatenate(x) for x in zip(*[[out.column(i).to_numpy() for i in range(2)] for out in neardup._prefixes(3, neardup._sent(neardup._level(levels)), threshold)(iter([batch]))])]
    order = np.argsort(rows[0].view(np.uint64) >> np.uint64(neardup.PLACE_BITS + 2), kind="stable")
    cut = np.array_split(order, 7)
    blocks = [pa.RecordBatch.from_arrays([pa.array(r[i]) for r in rows], names=["g", "w"]) for i in cut]
    lists = list(neardup._product(threshold, 8)(iter(blocks)))
    c = np.concatenate([x.column(0).to_numpy() for x in lists])
    met = [m for x in lists for m in x.column(1).to_pylist()]
    order = np.argsort(c, kind="stable").tolist()
    table = pa.RecordBatch.from_arrays([pa.array(c[order]), pa.array([met[i] for i in order], pa.binary())], names=["bucket", "met"])
    out = list(neardup._often(iter([table.slice(0, 5), table.slice(5)])))
    return {(a & 0xFFFFFFFF, b & 0xFFFFFFFF) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}


@pytest.mark.parametrize("hot", [3, 10, 4096])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_no_pair_is_lost(monkeypatch, hot, threshold):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "HOT_LEVEL", int(neardup._level(np.array([float(hot)]))[0]))
    monkeypatch.setattr(neardup, "_ROWS", 50)
    monkeypatch.setattr(neardup, "_EVENTS", 20)
    rng = random.Random(hot)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))]
        texts += [" ".join(w if rng.random() > 0.05 else "z" for w in base) for _ in range(rng.randrange(1, 5))]
    owner, grams, heads = neardup._sets(*neardup._ngrams(pa.array(texts), 3), None)
    names = neardup._names(heads[1])
    found = pairs_met(texts, threshold)
    ends = np.r_[heads[0][1:], len(owner)]
    sets = {(c, n): set(grams[a:z].tolist()) for c, n, a, z in zip(heads[1].tolist(), names.tolist(), heads[0].tolist(), ends.tolist())}
    for (x, a), (y, b) in combinations(sets.items(), 2):
        if len(a & b) >= threshold * len(a | b):
            assert (x[1], y[1]) in found or (y[1], x[1]) in found


def test_cells_meet_once(monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    n = 23
    level = np.full(n, neardup._level(np.array([float(n)]))[0])
    who = (np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(9)
    monkeypatch.setattr(neardup, "HOT_LEVEL", int(neardup._level(np.array([4.0]))[0]))
    g, place, tag, who = neardup._cells(np.full(n, 77, dtype=np.uint64), np.zeros(n, dtype=np.uint64), level, who)
    key = (g << np.uint64(neardup.PLACE_BITS + 2)) | (place << np.uint64(2)) | tag
    meetings = [(a, b) for x, y in neardup._meet(key, who, 0.5) for a, b in zip(x.tolist(), y.tolist())]
    assert len(meetings) == len(set(meetings)) == n * (n - 1) // 2


def test_counters_come_back():
    at, n = np.array([0, 5, 4095]), np.array([1, 300, 70000], dtype=np.uint32)
    out = neardup._unsqueeze(*neardup._squeeze(at, n))
    assert out[at].tolist() == n.tolist() and out.sum() == n.sum()


def test_equal_names_of_different_classes_meet():
    who = np.array([(7 << 32) | 30] * 3 + [(9 << 32) | 30], dtype=np.uint64)
    g = np.full(4, 5 << (neardup.PLACE_BITS + 2), dtype=np.uint64)
    met = [p for a, b in neardup._meet(g, who, 0.5) for p in zip(a.tolist(), b.tolist())]
    assert set(met) == {(7, 7), (7, 9)} and met.count((7, 7)) == neardup.SHARED
