"""Near-duplicate records with small edits (problem 2).

Documents and word n-grams form a sparse incidence matrix A; documents that share many n-grams
are large entries of A A'.  The product is taken in blocks of n-gram columns (the partitions of a
shuffle by n-gram), each block accumulates the overlaps of the pairs it sees, and bounds
derived from the sizes leave most of the matrix out without losing a pair:

* sizes must lie within the factor t;
* columns are in one order for all documents, rare ones first (by a counting sketch of fixed
  size over all n-grams), and a pair whose overlap must be o = ceil(t/(1+t) (n + m)) or more shares
  ``SHARED`` of the first n - o + SHARED columns of one and m - o + SHARED of the other (or o of
  all, where o is less);
* what stands before and behind a shared column must leave room for an overlap of
  t / (1 + t) of the sum of the sizes;
* a column whose counter is 1 belongs to one document and is left out (its place still counts).

A block writes, by document, the 32-bit names of those it meets.  They are added up by
document; pairs met ``SHARED`` times are candidates, and candidates are verified on whole sets.
Documents with equal sets are one class (128 bits); the product is taken over classes, and copies
within one task are merged before any shuffle.  A column that the sketch says more than ``HOT``
documents have is a square of cells, each a block of its own.

Defined cases: null or empty texts, and texts of fewer words than an n-gram, have no set and are
in no pair; a null title counts as empty; a key that occurs with several contents is in the
class of each; a key is no pair with itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SKETCH_BITS = 24
FILTER_BITS = 23
GRAM_BITS = 40
PLACE_BITS = 14
SHARED = 6
HOT = 4096
_BLOCK = 1 << 12
_ROWS = 1 << 19
_EVENTS = 1 << 21
_SEED = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)
_BYTES = GRAM_BITS // 8
_FAR = (1 << PLACE_BITS) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ngrams(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram of GRAM_BITS) of every n-gram of every text, in order; words are runs of letters or digits in lower case."""
    words = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{N}]+")
    lengths = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    names = flat.dictionary.to_pylist()
    hashes = pd.util.hash_array(np.array(names, dtype=object), categorize=False) if names else np.array([], dtype=np.uint64)
    docs = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    if "" in names:
        kept = codes != names.index("")
        codes, docs = codes[kept], docs[kept]
    if len(codes) < width:
        return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
    w = hashes[codes]
    n = len(w) - width + 1
    out = w[:n]
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = _mix(out * np.uint64(3) + _SEED) ^ w[i : n + i]
    whole = docs[:n] == docs[width - 1 :]
    return docs[:n][whole], _mix(out[whole]) >> np.uint64(64 - GRAM_BITS)


def _joined(batch: pa.RecordBatch, first: int) -> pa.Array:
    parts = [pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in range(first, batch.num_columns)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2 ** 16 rows, so that a row's number, a rank and an n-gram fit 64 bits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(at, 1 << 16)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _sketch(width: int):  # noqa: ANN202
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in _slices(batches):
            _, grams, _ = _sets(*_ngrams(_joined(batch, 0), width), None)
            slots, n = np.unique(_slot(grams), return_counts=True)
            counters[slots] += n.astype(np.uint32)
        used = np.flatnonzero(counters)
        cut = np.searchsorted(used, np.arange(0, (1 << SKETCH_BITS) + 1, _BLOCK))
        rows = [(i, *_squeeze(used[a:z] - i * _BLOCK, counters[used[a:z]])) for i, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if z > a]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "bits", "low", "high"])

    return count


def _squeeze(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Counters of a block: which are used as bits, their low bytes, and (place, rest) of those above 255."""
    bits = np.zeros(_BLOCK, dtype=bool)
    bits[at] = True
    big = np.flatnonzero(n > 255)
    return np.packbits(bits).tobytes(), (n & 255).astype(np.uint8).tobytes(), np.stack([at[big], n[big] >> 8]).astype(np.uint32).tobytes()


def _unsqueeze(bits: bytes, low: bytes, high: bytes) -> np.ndarray:
    out = np.zeros(_BLOCK, dtype=np.int64)
    out[np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)))] = np.frombuffer(low, dtype=np.uint8)
    at, rest = np.frombuffer(high, dtype=np.uint32).reshape(2, -1).astype(np.int64)
    out[at] += rest << 8
    return out


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte; 0 and 1 keep values of their own."""
    return np.minimum(255, np.round(np.log2(counts + 1.0) * 8)).astype(np.uint8)


_ONE = 8


def _add(table: pa.Table) -> pa.Table:
    sums = np.zeros(_BLOCK, dtype=np.int64)
    for row in zip(*[table.column(c).to_pylist() for c in ("bits", "low", "high")]):
        sums += _unsqueeze(*row)
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([_level(sums).tobytes()], pa.binary())], names=["block", "levels"])


def gram_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """In how many documents n-grams are: 2 ** SKETCH_BITS counters whatever the size of the collection, on a logarithmic scale of one byte."""
    rows = texts.mapInArrow(_sketch(width), "block int, bits binary, low binary, high binary").groupBy("block").applyInArrow(_add, "block int, levels binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in rows:
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def _sets(docs: np.ndarray, grams: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram), ordered by document, then rank, then n-gram; and where documents begin, with the two halves of their class."""
    order = np.zeros(len(grams), dtype=np.uint64) if rank is None else rank[_slot(grams)].astype(np.uint64)
    key = np.sort((docs.astype(np.uint64) << np.uint64(48)) | (order << np.uint64(GRAM_BITS)) | grams)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> np.uint64(48)).astype(np.int64)
    grams = key & np.uint64((1 << GRAM_BITS) - 1)
    if not len(owner):
        return owner, grams, np.zeros((3, 0), dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    with np.errstate(over="ignore"):
        one = _mix(np.add.reduceat(_mix(grams + _SEED), starts))
        two = _mix(np.add.reduceat(_mix(grams * _OTHER + _SEED), starts))
    return owner, grams, np.stack([starts.astype(np.int64), one.view(np.int64), two.view(np.int64)])


def _fresh(seen: set[tuple[int, int]], heads: np.ndarray) -> np.ndarray:
    """Which classes this task has not met yet."""
    return np.array([c not in seen and not seen.add(c) for c in zip(heads[1].tolist(), heads[2].tolist())], dtype=bool)


def _names(classes: np.ndarray) -> np.ndarray:
    """32-bit names of classes."""
    return (_mix(classes.view(np.uint64) + _SEED) >> np.uint64(32)).astype(np.uint32)


def _sent(values: np.ndarray) -> bytes:
    """Bytes for the executors: every one of them keeps a copy."""
    return zlib.compress(values.tobytes(), 1)


def _got(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def _prefixes(width: int, levels: bytes, threshold: float):  # noqa: ANN202
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _got(levels)
        seen: set[tuple[int, int]] = set()
        for batch in _slices(batches):
            owner, grams, heads = _sets(*_ngrams(_joined(batch, 0), width), rank)
            fresh = _fresh(seen, heads)
            starts, names, sizes = heads[0][fresh], _names(heads[1][fresh]), np.diff(np.r_[heads[0], len(owner)])[fresh]
            longest = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + SHARED)
            place = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest)
            grams = grams[np.repeat(starts, longest) + place]
            level = rank[_slot(grams)]
            some = level != _ONE
            grams, place, level = grams[some], np.minimum(place[some], _FAR).astype(np.uint64), level[some]
            who = np.repeat((names.astype(np.uint64) << np.uint64(32)) | sizes.astype(np.uint64), longest)[some]
            tag = np.zeros(len(grams), dtype=np.uint64)
            if len(level) and level.max() > HOT_LEVEL:
                grams, place, tag, who = _cells(grams, place, level, who)
            key = (grams << np.uint64(PLACE_BITS + 2)) | (place << np.uint64(2)) | tag
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who.view(np.int64))], names=["g", "w"])

    return emit


HOT_LEVEL = int(_level(np.array([float(HOT)]))[0])


def _cells(grams: np.ndarray, place: np.ndarray, level: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of hot columns, repeated for the cells they are in: a column of s strips has s (s + 1) / 2 cells, a strip is in s of them.

    A cell is a column by another name; tag 0 meets all rows of its cell, 1 only those of tag 2.
    """
    strips = np.where(level > HOT_LEVEL, np.ceil(2.0 ** (level.astype(float) / 8) / HOT), 1).astype(np.int64)
    own = (_mix(who + _OTHER) % strips.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(grams)), strips)
    other = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
    own, many = own[row], strips[row] > 1
    low, high = np.minimum(own, other), np.maximum(own, other)
    with np.errstate(over="ignore"):
        cell = _mix(grams[row] * _OTHER + low.astype(np.uint64) * _SEED + high.astype(np.uint64)) >> np.uint64(64 - GRAM_BITS)
    tag = np.where(own < other, 1, np.where(own > other, 2, 0)).astype(np.uint64)
    return np.where(many, cell, grams[row]), place[row], tag, who[row]


def _meet(g: np.ndarray, w: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(name of the smaller, of the larger) of the pairs that meet in a column within the bounds; whole columns only, in order.

    Where less than SHARED columns must be shared, a meeting counts several times, so that SHARED meetings are needed of all.
    Rows of one name and size are one (copies from several tasks); they meet themselves once, in case they are not copies.
    """
    column = g >> np.uint64(PLACE_BITS + 2)
    n, names = (w & np.uint64(0xFFFFFFFF)).astype(np.int64), (w >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((g, names, n, column))
    g, n, names, column = g[order], n[order], names[order], column[order]
    same = np.zeros(len(g), dtype=bool)
    same[1:] = (g[1:] == g[:-1]) & (n[1:] == n[:-1]) & (names[1:] == names[:-1])
    twins = names[same & ~np.r_[same[1:], False]]
    kept, held = [(np.repeat(twins, SHARED), np.repeat(twins, SHARED))], len(twins) * SHARED
    g, n, names, column = g[~same], n[~same], names[~same], column[~same]
    place, tag = ((g >> np.uint64(2)) & np.uint64(_FAR)).astype(np.int64), (g & np.uint64(3)).astype(np.int8)
    share = threshold / (1 + threshold)
    first, step = np.arange(len(g)), 1
    while len(first):
        first = first[first + step < len(g)]
        second = first + step
        near = (column[first] == column[second]) & (n[first] >= threshold * n[second] - 1e-9)
        first, second = first[near], second[near]
        x, y, xp, yp = n[first], n[second], place[first], place[second]
        least = np.ceil((x + y) * share - 1e-9).astype(np.int64)
        room = (np.minimum(xp, yp) + np.minimum(x - xp, y - yp) >= least) & (xp < x - least + SHARED) & (yp < y - least + SHARED)
        ok = (room | (np.maximum(xp, yp) == _FAR)) & ((tag[first] != tag[second]) | (tag[first] == 0))
        times = np.maximum(1, -(-SHARED // np.maximum(1, least[ok])))
        kept.append((np.repeat(names[first][ok], times), np.repeat(names[second][ok], times)))
        held += len(kept[-1][0])
        if held > _EVENTS:
            yield np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            kept, held = [], 0
        step += 1
    if held:
        yield np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _lists(a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pairs of names by bucket of the first: which first names, how often each, and the second names."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    names, counts = a[starts], np.diff(np.r_[starts, len(a)]).astype(np.uint32)
    bucket = (names.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(names)]):
        low, high = starts[i], starts[j] if j < len(names) else len(a)
        rows.append((int(bucket[i]), np.array([j - i], dtype=np.uint32).tobytes() + names[i:j].tobytes() + counts[i:j].tobytes() + b[low:high].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "met"])


def _unlisted(met: bytes) -> np.ndarray:
    """The pairs of a row, as one number each."""
    x = np.frombuffer(met, dtype=np.uint32).astype(np.uint64)
    n = int(x[0])
    return (np.repeat(x[1 : n + 1], x[n + 1 : 2 * n + 1].astype(np.int64)) << np.uint64(32)) | x[2 * n + 1 :]


def _product(threshold: float, buckets: int):  # noqa: ANN202
    """One block of the product; rows come ordered by column."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def whole(last: bool) -> tuple[np.ndarray, ...]:
            nonlocal waiting, held
            g, w = (np.concatenate([x[i] for x in waiting]) for i in range(2))
            column = g >> np.uint64(PLACE_BITS + 2)
            end = len(g) if last else int(np.searchsorted(column, column[-1]))
            waiting, held = [(g[end:], w[end:])], len(g) - end
            return g[:end], w[:end]

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)))
            held += batch.num_rows
            if held >= _ROWS:
                for a, b in _meet(*whole(False), threshold):
                    yield _lists(a, b, buckets)
        if held:
            for a, b in _meet(*whole(True), threshold):
                yield _lists(a, b, buckets)

    return multiply


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of names that met SHARED times; rows come ordered by bucket."""
    now: int | None = None
    pairs, counts = np.array([], dtype=np.uint64), np.array([], dtype=np.int64)

    def found() -> pa.RecordBatch:
        kept = pairs[counts >= SHARED]
        a, b = (kept >> np.uint64(32)).astype(np.uint32), (kept & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int32)), pa.array(b.view(np.int32))], names=["na", "nb"])

    for batch in batches:
        bucket, met = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(bucket) else []
        for at, end in zip(starts, [*starts[1:], len(bucket)]):
            if now is not None and bucket[at] != now:
                yield found()
                pairs, counts = np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
            now = int(bucket[at])
            new, n = np.unique(np.concatenate([_unlisted(m) for m in met[at:end]]), return_counts=True)
            if len(pairs):
                both, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                new, n = both, np.bincount(place, weights=np.concatenate([counts, n])).astype(np.int64)
            pairs, counts = new, n
    if now is not None:
        yield found()


def _slots(names: np.ndarray) -> np.ndarray:
    return (names & np.uint32((1 << FILTER_BITS) - 1)).astype(np.int64)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        for i in (0, 1):
            bits[_slots(batch.column(i).to_numpy().view(np.uint32))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def class_filter(pairs: DataFrame) -> np.ndarray:
    """A filter of fixed size (2 ** FILTER_BITS bits) that lets pass every class in ``pairs``."""
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for r in pairs.coalesce(8).mapInArrow(_present, "bits binary").toLocalIterator():
        bits |= np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)).astype(bool)
    return bits


def _records(width: int, classes: bytes):  # noqa: ANN202
    """Every record that has a set, with its class; and the set, once a task, where the class is wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(_got(classes)).astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in _slices(batches):
            owner, grams, heads = _sets(*_ngrams(_joined(batch, 1), width), None)
            ends = np.r_[heads[0][1:], len(owner)]
            names = _names(heads[1])
            some = wanted[_slots(names)]
            some[some] = _fresh(seen, heads[:, some])
            narrow = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :_BYTES])
            packed = [narrow[a:z].tobytes() if s else None for a, z, s in zip(heads[0].tolist(), ends.tolist(), some.tolist())]
            rows = owner[heads[0]] if len(owner) else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(heads[1]), pa.array(heads[2]), pa.array(names.view(np.int32)), pa.array(packed, pa.binary())],
                names=["key", "c", "d", "name", "grams"],
            )

    return emit


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), dtype=np.uint8)
    out[:, :_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _BYTES)
    return out.view(np.uint64).ravel()


def _similar(threshold: float):  # noqa: ANN202
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = _unpacked(x), _unpacked(y)
                together = np.sort(np.concatenate([x, y]))
                both = int((together[1:] == together[:-1]).sum())
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    kept.append(i)
            yield batch.select([0, 1, 2, 3]).take(pa.array(kept, pa.int64()))

    return keep


def similar_classes(df: DataFrame, key: str, columns: tuple[str, ...], width: int = 3, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(ca, cb) of every pair of classes whose sets of n-grams have at least ``threshold`` of their union in common, and (key, c) of
    every record that has a set; a class is a struct of two halves, repeated records give repeated rows."""
    from folioflow.plans.lineage import settle

    src = df.where(F.col(columns[-1]).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    texts = src.drop("key")
    rank = gram_sketch(texts, width)
    prefix = texts.mapInArrow(_prefixes(width, _sent(rank), threshold), "g long, w long")
    # rows are about twice the texts' bytes: two blocks for each split of the texts keep blocks at the splits' size at any scale
    # ordered as unsigned numbers are, since the product cuts columns by their place in that order
    parts = max(2 * texts.rdd.getNumPartitions(), texts.sparkSession.sparkContext.defaultParallelism)
    blocks = prefix.repartition(parts, F.shiftright("g", PLACE_BITS + 2)).sortWithinPartitions(F.shiftrightunsigned("g", PLACE_BITS + 2))
    met = blocks.mapInArrow(_product(threshold, 16 * parts), "bucket int, met binary")
    candidates = settle(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_often, "na int, nb int"))
    kind = dict(src.dtypes)["key"]
    records = settle(src.mapInArrow(_records(width, _sent(np.packbits(class_filter(candidates)))), f"key {kind}, c long, d long, name int, grams binary"))
    # by name only, so that both joins below go without another shuffle of the sets
    sets = records.where("grams is not null").select("name", "c", "d", "grams").repartition("name").groupBy("name", "c", "d").agg(F.first("grams").alias("grams"))
    a = sets.select(F.col("name").alias("na"), F.struct("c", "d").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("name").alias("nb"), F.struct("c", "d").alias("b"), F.col("grams").alias("gb"))
    paired = candidates.join(a, "na").join(b, "nb").where("(na <> nb and a <> b) or a < b")
    verified = paired.select("a.c", "a.d", F.col("b.c").alias("bc"), F.col("b.d").alias("bd"), "ga", "gb").mapInArrow(_similar(threshold), "c long, d long, bc long, bd long")
    links = verified.select(F.struct("c", "d").alias("ca"), F.struct(F.col("bc").alias("c"), F.col("bd").alias("d")).alias("cb"))
    return links, records.select("key", F.struct("c", "d").alias("c"))


def similar_pairs(df: DataFrame, key: str = "doc_number", columns: tuple[str, ...] = ("title", "text"), width: int = 3, threshold: float = 0.5) -> DataFrame:
    """key_a < key_b of every pair of similar records, copies included."""
    links, who = similar_classes(df, key, columns, width, threshold)
    a, b = who.select(F.col("key").alias("ka"), F.col("c").alias("ca")), who.select(F.col("key").alias("kb"), F.col("c").alias("cb"))
    across = links.join(a, "ca").join(b, "cb").select("ka", "kb")
    within = a.join(b, (F.col("ca") == F.col("cb")) & (F.col("ka") < F.col("kb"))).select("ka", "kb")
    pairs = across.unionByName(within).where("ka <> kb").select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
    return pairs.distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """c, root: the least class id of every component, by alternating large-star and small-star steps on shared tables.

    Stops when no link changes; ``rounds`` is a guard against an endless loop (the number needed grows with the logarithm
    of the longest chain) and running into it is an error.
    """
    from folioflow.plans.lineage import settle

    edges = settle(links.select(F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = settle(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("c").distinct().join(roots, F.col("c") == F.col("u"), "left").select("c", F.coalesce("root", "c").alias("root"))


def similar_groups(df: DataFrame, key: str = "doc_number", columns: tuple[str, ...] = ("title", "text"), width: int = 3, threshold: float = 0.5) -> DataFrame:
    """key, class_id, n_links (to other classes), group_id of every record with a set."""
    from folioflow.plans.lineage import settle

    links, who = similar_classes(df, key, columns, width, threshold)
    links, who = settle(links.distinct()), settle(who.distinct())
    degree = links.select(F.col("ca").alias("c")).unionByName(links.select(F.col("cb").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    out = who.join(components(who, links), "c").join(degree, "c", "left")
    named = {c: F.concat(*[F.lpad(F.lower(F.hex(f"{c}.{half}")), 16, "0") for half in ("c", "d")]) for c in ("c", "root")}
    return out.select(F.col("key").alias(key), named["c"].alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), named["root"].alias("group_id"))
