"""Evaluation texts leaking into training text (problem 8).

Pigeonhole edit matching.  A passage of an item counts as leaked if ``run`` consecutive words of
it stand in a document with at most ``budget`` words changed, left out or put in.  Every item is
cut into aligned pieces of (run + 1) // (budget + 2) words: any run of the item then holds
budget + 1 whole pieces, one of which must stand in the document unchanged.  Pieces are hashed; a
bitmap of fixed size over the items' pieces picks, in one scan of the documents, the places worth
a look, and these meet the pieces in a join on the hash, each with the words around it.  Where these
hold enough of the item's words, every run with the piece is held against them by Myers' bit-parallel
distance, which alone decides.  No item and no document is gathered anywhere.

Texts are compared as words in one form: look-alike letters, accents, widths, invisible
characters, case, punctuation and spacing do not count.

Defined cases: null and empty texts and items of fewer words than ``run`` leak nothing; several
items with equal passages are all reported; repeated rows give one result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folioflow.llm import lookalike
from folioflow.plans.lineage import settle, spread

BITMAP_BITS = 26
_WORD = re.compile(r"[^\W_]+")
_SEED = np.uint64(0x9E3779B97F4A7C15)
_FOLD = str.maketrans(
    {c: a for a, c in zip(*lookalike.LATIN_CYRILLIC, strict=True)} | {c: a for a, c in zip(*lookalike.LATIN_GREEK, strict=True)}
)


def words(text: str) -> list[str]:
    """The words of a text in one form, in which look-alike letters of all scripts are the same."""
    if not text.isascii():
        text = lookalike.canonical(text).translate(_FOLD)
    return _WORD.findall(text.casefold())


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every word of every text, in order; every distinct run of letters, marks and digits is formed once."""
    plain = pc.replace_substring_regex(texts.cast(pa.large_string()), lookalike._IGNORABLE.pattern, "")
    runs = pc.split_pattern_regex(plain, r"[^\p{L}\p{M}\p{N}]+")
    lengths = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten().dictionary_encode()
    parts = [words(x) for x in flat.dictionary.to_pylist()]
    counts = np.array([len(x) for x in parts], dtype=np.int64)
    names = [w for x in parts for w in x]
    if not names:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    hashes = pd.util.hash_array(np.array(names, dtype=object), categorize=False)
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = counts[codes]
    first = np.cumsum(counts) - counts
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[codes], n)
    return np.repeat(np.repeat(np.arange(len(lengths)), lengths), n), hashes[at]


def _rolled(w: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` words in a row."""
    n = max(0, len(w) - width + 1)
    out = w[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = ((out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + _SEED) ^ w[i : n + i]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def myers(pattern: list, text: list) -> int:
    """The least edit distance between the pattern and any stretch of the text, by bit vectors over the pattern's places."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | (1 << i)
    up, down, score = full, 0, m
    best = score
    for w in text:
        eq = masks.get(w, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = down | (~(across | up) & full)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        vertical = eq | down
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        best = min(best, score)
    return best


def _around(owner: np.ndarray, w: np.ndarray, at: np.ndarray, before: int, behind: int) -> tuple[pa.Array, np.ndarray]:
    """The words from ``before`` words before each place to ``behind`` behind it, within its text; and where the place is in them."""
    bounds = np.searchsorted(owner, [owner[at], owner[at] + 1]) if len(at) else np.zeros((2, 0), dtype=np.int64)
    low, high = np.maximum(bounds[0], at - before), np.minimum(bounds[1], at + behind)
    ends = np.r_[0, np.cumsum(high - low)]
    places = np.arange(ends[-1]) - np.repeat(ends[:-1], high - low) + np.repeat(low, high - low)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w[places].view(np.int64))), at - low


def _pieces(run: int, width: int):  # noqa: ANN202
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, w = word_hashes(batch.column(1))
            sizes = np.bincount(owner, minlength=batch.num_rows)
            first = (np.cumsum(sizes) - sizes)[owner] if len(owner) else owner
            place = np.arange(len(owner)) - first
            at = np.flatnonzero((place % width == 0) & (place + width <= sizes[owner]) & (sizes[owner] >= run)) if len(owner) else np.array([], dtype=np.int64)
            context, off = _around(owner, w, at, run - width, run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_rolled(w, width)[at].view(np.int64)), batch.column(0).take(pa.array(owner[at])), pa.array(place[at], pa.int32()), context, pa.array(off, pa.int32())],
                names=["h", "item", "at", "words", "off"],
            )

    return emit


def _hits(run: int, width: int, budget: int, bitmap: bytes):  # noqa: ANN202
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)
        for batch in batches:
            owner, w = word_hashes(batch.column(1))
            rolled = _rolled(w, width)
            slot = _bit(rolled)
            at = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            at = at[owner[at] == owner[at + width - 1]]
            context, off = _around(owner, w, at, run - width + budget, run + budget)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolled[at].view(np.int64)), batch.column(0).take(pa.array(owner[at])), context, pa.array(off, pa.int32())], names=["h", "doc", "near", "place"]
            )

    return emit


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy().view(np.uint64))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def piece_bitmap(pieces: DataFrame) -> bytes:
    """2 ** BITMAP_BITS bits, whatever the number of items, of which those of the pieces' hashes are set; compressed."""
    bits = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for r in pieces.select("h").coalesce(4).mapInArrow(_marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], dtype=np.uint8)
    return zlib.compress(bits.tobytes(), 1)


def least_changes(item: list[int], off: int, near: list[int], place: int, run: int, width: int, budget: int) -> int:
    """The least changes of any run of the item that holds the piece at ``off``, near the piece's place in the document."""
    best = budget + 1
    for start in range(max(0, off + width - run), min(off, len(item) - run) + 1):
        low = max(0, place - (off - start) - budget)
        best = min(best, myers(item[start : start + run], near[low : place + run - (off - start) + budget]))
        if not best:
            break
    return best


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and which of its cells are given."""
    sizes = np.diff(column.offsets.to_numpy())
    given = np.arange(max(1, sizes.max(initial=0))) < sizes[:, None]
    out = np.zeros(given.shape, dtype=np.int64)
    out[given] = column.flatten().to_numpy()
    return out, given


def may_hold(items: pa.Array, near: pa.Array, run: int, budget: int) -> np.ndarray:
    """Where some run of the item has all but ``budget`` of its words, in any order, among the document's: necessary for a leak."""
    out = np.zeros(len(items), dtype=bool)
    for at in range(0, len(items), 4096):
        (x, x_given), (y, y_given) = _padded(items.slice(at, 4096)), _padded(near.slice(at, 4096))
        held = ((x[:, :, None] == y[:, None, :]) & y_given[:, None, :]).any(axis=2) & x_given
        sums = np.cumsum(np.pad(held, ((0, 0), (1, 0))), axis=1)
        if sums.shape[1] > run:
            out[at : at + 4096] = (sums[:, run:] - sums[:, :-run] >= run - budget).any(axis=1)
    return out


def _verify(run: int, width: int, budget: int):  # noqa: ANN202
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(may_hold(batch.column(3), batch.column(5), run, budget))))
            known: dict[tuple, int] = {}
            changes = []
            for item, off, near, place in zip(*[batch.column(i).to_pylist() for i in range(3, 7)]):
                key = (tuple(item), off, tuple(near), place)
                if key not in known:
                    known[key] = least_changes(item, off, near, place, run, width, budget)
                changes.append(known[key])
            kept = pa.array([i for i, n in enumerate(changes) if n <= budget], pa.int64())
            out = batch.select([0, 1, 2]).take(kept)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(changes, pa.int32()).take(kept)], names=["item", "doc", "at", "changes"])

    return check


def find_leaks(docs: DataFrame, items: DataFrame, run: int = 12, budget: int = 1, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """item, doc, changes (0 to ``budget``, the least of any run), pieces (of the item, about which runs were found) of every leak."""
    width = max(1, (run + 1) // (budget + 2))
    src = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("t")))
    asked = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("t")).distinct()
    doc_type, item_type = dict(src.dtypes)["doc"], dict(asked.dtypes)["item"]
    pieces = settle(asked.mapInArrow(_pieces(run, width), f"h long, item {item_type}, at int, words array<long>, off int"))
    hits = src.mapInArrow(_hits(run, width, budget, piece_bitmap(pieces)), f"h long, doc {doc_type}, near array<long>, place int")
    met = hits.join(pieces, "h").select("item", "doc", "at", "words", "off", "near", "place")
    found = met.mapInArrow(_verify(run, width, budget), f"item {item_type}, doc {doc_type}, at int, changes int")
    return found.groupBy(F.col("item").alias(item), F.col("doc").alias(doc)).agg(F.min("changes").alias("changes"), F.count_distinct("at").cast("int").alias("pieces"))
