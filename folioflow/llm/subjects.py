"""Subject area of each document (problem 5).

The document-term matrix is factored, X ~ W H, with one component for each subject.  H is seeded
with the key words of the subjects and W with the subjects that raters gave to some documents,
so that every component stays anchored to its subject; then W and H are updated in turn by the
non-negative multiplicative rule for the Kullback-Leibler divergence.  Words of languages without
key words get their weights through the rated documents and through words in common.

Terms are words; runs of Chinese letters give their pairs, of Thai and the like their
four-letter pieces.  Terms are hashed to 2 ** TERM_BITS columns of X, whatever the size of the vocabulary, so that H has a
fixed size and no term is left out for being frequent; a column of fewer than MIN_DOCUMENTS documents, a number that does
not grow, cannot be told from chance.  A term counts once a document, and counts for W by how unevenly it is spread over the
subjects; columns spread evenly by the middle of the rounds stay as they are.  Then every sentence is a document of its own: its mixture follows from H by the
same updates, begun at the mixture of the document it stands in, and its subject is the greatest component, or none.

Defined cases: null, empty and blank texts have no sentences and no subject; a text without
telling terms has none; a document with several texts has the subjects of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.sentences import sentence_spans

TERM_BITS = 19
MIN_DOCUMENTS = 10
SMOOTH = 8.0
FIRST_SMOOTH = 2.0
TELLING = 0.35
ROUNDS = 6
PRIOR = 0.05
ANCHOR = 0.05


def _hash(words: list[str]) -> np.ndarray:
    """Columns of terms."""
    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) >> np.uint64(64 - TERM_BITS)).astype(np.int32) if words else np.array([], dtype=np.int32)


def pieces(word: str) -> list[str]:
    """The terms of a run of letters and marks."""
    c = word[0]
    if "぀" <= c <= "鿿" or "가" <= c <= "힯":
        return [word[i : i + 2] for i in range(len(word) - 1)] or [word]
    if "฀" <= c <= "࿿" or "က" <= c <= "႟" or "ក" <= c <= "៿":
        return [word[i : i + 4] for i in range(len(word) - 3)] or [word]
    return [word]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts in a row, and how many each has."""
    words = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), r"[^\p{L}\p{M}]+")
    lengths = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [pieces(w) if w else [] for w in flat.dictionary.to_pylist()]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    hashes = _hash([x for p in parts for x in p])
    first = np.cumsum(counts) - counts
    n = counts[codes] if len(codes) else np.array([], dtype=np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[codes], n) if len(codes) else np.array([], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    return hashes[at] if len(at) else np.array([], dtype=np.int32), np.bincount(np.repeat(owner, n), minlength=len(texts))


# Frequent function words, by which texts in Latin letters are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in was for that with on", "de": "der die das und den nicht ist mit von für",
    "fr": "le la les et des est avec pour dans une", "es": "el los las y del por con una para que",
    "it": "il di che è per con non una della sono", "nl": "de het een van en niet met voor zijn op", "pt": "o os não uma do da em com para ao",
}


def _groups(terms: np.ndarray, owner: np.ndarray, texts: list[str]) -> np.ndarray:
    """A number for the language of each text: by its function words where it has Latin letters, else by its script."""
    tongues = sorted(FUNCTION_WORDS)
    counts = np.stack([np.bincount(owner[np.isin(terms, _hash(FUNCTION_WORDS[x].split()))], minlength=len(texts)) for x in tongues], axis=1)
    out = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1) + 1, 0)
    for i, text in enumerate(texts):
        if text.isascii():
            continue
        # blocks of 128 characters beyond the Latin ones, over the whole text
        blocks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blocks = np.bincount(np.minimum(blocks[blocks > 0x24F] >> 7, 1 << 14))
        blocks[0x2000 >> 7 : 0x2100 >> 7] = 0
        if blocks.sum() > max(40, 0.1 * len(text)):
            top = int(blocks.argmax())
            out[i] = 100 + (0x4E00 >> 7 if top >= 0x3000 >> 7 else top)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document the number of terms of each sentence, the terms, and each term once, the mark among them."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        spans = [sentence_spans(t) for t in texts]
        sizes = np.array([len(s) for s in spans], dtype=np.int64)
        terms, counts = _tokens([t[a:z] for t, s in zip(texts, spans) for a, z in s])
        ends = np.r_[0, np.cumsum(sizes)]
        places = np.r_[0, np.cumsum(counts)][ends]
        owner = np.repeat(np.arange(len(texts)), np.diff(places))
        marks = _hash(["mark " + (m or "").strip().lower() for m in batch.column(2).to_pylist()])
        once = np.unique((np.r_[owner, np.arange(len(texts))] << 32) | np.r_[terms, marks])
        bounds = np.searchsorted(once, np.arange(len(texts) + 1) << 32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(_groups(terms, owner, [t or "" for t in texts]), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())),
                pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(terms, pa.int32())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(once & 0xFFFFFFFF, pa.int32())),
            ],
            names=["key", "tongue", "lengths", "terms", "once"],
        )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term by language; the term -1 stands for all documents."""
    for batch in batches:
        rows, terms = _flat(batch.column(1))
        tongue = batch.column(0).to_numpy()
        pairs, n = np.unique((tongue[rows].astype(np.int64) << 32) | terms, return_counts=True)
        groups, every = np.unique(tongue, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[pairs >> 32, groups]), pa.array(np.r_[pairs & 0xFFFFFFFF, np.full(len(groups), -1)]), pa.array(np.r_[n, every])], names=["tongue", "term", "n"]
        )


class Factors:
    """The columns of H (their numbers, in order), a row of weights for each, and the language each is most at home in."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, home: np.ndarray) -> None:
        self.columns, self.weights, self.home = columns, weights, home

    def relative(self, smooth: float) -> np.ndarray:
        """What a term says of the subjects: weights over the subjects' sizes, as shares, few documents drawn to the even share."""
        k = self.weights.shape[1]
        if not len(self.columns):
            return np.zeros((0, k))
        # the size of a subject is taken by language, so that no subject grows by swallowing a whole language
        mass = np.zeros((self.home.max() + 1, k))
        np.add.at(mass, self.home, self.weights)
        mass += 0.02 * mass.sum(axis=1, keepdims=True) / k + 1e-9
        even = mass / mass.sum(axis=1, keepdims=True)
        w = (self.weights + smooth * even[self.home]) / mass[self.home]
        return w / w.sum(axis=1, keepdims=True)

    def told(self, smooth: float, least: float = -1.0) -> Told:
        """For the executors, the columns more uneven than ``least``."""
        share = self.relative(smooth)
        uneven = self.unevenness(share)
        some = np.flatnonzero(uneven > least)
        place = np.full(1 << TERM_BITS, -1, dtype=np.int32)
        place[self.columns[some]] = np.arange(len(some))
        return Told(place, some, share[some].astype(np.float32), np.where(uneven[some] >= TELLING, uneven[some], 0.0).astype(np.float32))

    @staticmethod
    def unevenness(share: np.ndarray) -> np.ndarray:
        """How unevenly a term is spread, from 0 to 1."""
        k = share.shape[1]
        return (share.max(axis=1) - 1 / k) / max(1e-9, 1 - 1 / k) if len(share) else np.zeros(0)


@dataclass
class Told:
    """What executors know of H: the place of each column (-1: none), the columns' places in Factors, shares, and weights (0 below TELLING)."""

    place: np.ndarray
    rows: np.ndarray
    share: np.ndarray
    q: np.ndarray


def _mixtures(rows: np.ndarray, at: np.ndarray, n: int, share: np.ndarray, q: np.ndarray, given: np.ndarray | None = None, steps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(W of each document, how much the document can tell), by multiplicative updates with H fixed; ``rows`` are in order."""
    k = share.shape[1]
    w = np.full((n, k), 1.0 / k, dtype=np.float32)
    known = np.zeros(n)
    if given is not None:
        given = given.astype(np.float32)
        w = given * np.float32(0.8) + (1 - 0.8 * given.sum(axis=1, keepdims=True)) / k
        known += 2.0 * given.sum(axis=1)
    some = q[at] > 0
    rows, at = rows[some], at[some]
    s, qt = share[at], q[at]
    known += np.bincount(rows, qt, n)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], dtype=np.int64)
    for _ in range(steps):
        sums = np.full((n, k), 0.05, dtype=np.float32)
        if len(rows):
            owed = w[rows] * s
            owed *= (qt / owed.sum(axis=1))[:, None]
            sums[rows[starts]] += np.add.reduceat(owed, starts, axis=0)
        if given is not None:
            sums += 2.0 * given
        w = sums / sums.sum(axis=1, keepdims=True)
    return w, known / (known + 1.0)


def _sentence_mixtures(rows: np.ndarray, at: np.ndarray, first: np.ndarray, share: np.ndarray, q: np.ndarray, steps: int = 2) -> np.ndarray:
    """W of each sentence from its first values, by multiplicative updates with H fixed; ``rows`` are in order."""
    w = first / first.sum(axis=1, keepdims=True)
    if not len(rows):
        return w
    s, qt = share[at], q[at]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    here = rows[starts]
    for _ in range(steps):
        owed = w[rows] * s
        owed *= (qt / owed.sum(axis=1))[:, None]
        sums = np.add.reduceat(owed, starts, axis=0) + ANCHOR * first[here]
        w[here] = sums / sums.sum(axis=1, keepdims=True)
    return w


def _presence(shared):  # noqa: ANN001, ANN202
    """Of every document the columns of H it holds, once each and in order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.place
        for batch in batches:
            rows, terms = _flat(batch.column(1))
            some = place[terms] >= 0
            ends = np.r_[0, np.cumsum(np.bincount(rows[some], minlength=batch.num_rows))]
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms[some], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["key", "held"])

    return emit


def _update(shared, k: int):  # noqa: ANN001, ANN202
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Told = shared.value
        share, q = told.share, told.q
        total = np.zeros((len(q), k))
        for batch in batches:
            rows, at = _flat(batch.column(0))
            at = told.place[at]
            rows, at = rows[at >= 0], at[at >= 0]
            given = np.zeros((batch.num_rows, k))
            r, v = _flat(batch.column(1))
            given[r, v] = 1.0
            given /= np.maximum(1, given.sum(axis=1, keepdims=True))
            w, trust = _mixtures(rows, at, batch.num_rows, share, q, given, 3)
            owed = w[rows] * share[at]
            owed *= (trust[rows].astype(np.float32) / owed.sum(axis=1))[:, None]
            for j in range(k):
                total[:, j] += np.bincount(at, owed[:, j], len(total))
        some = np.flatnonzero(total.sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(told.rows[some], pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["at", "w"])

    return sums


def _decide(shared, subjects: list[str], least: float):  # noqa: ANN001, ANN202
    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Told = shared.value
        share, q = told.share, told.q
        k = len(subjects)
        for batch in batches:
            owner, lengths = _flat(batch.column(1))
            sentence = np.repeat(np.arange(len(owner)), lengths)
            place = told.place[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            sentence, place = sentence[place >= 0], place[place >= 0]
            rows, held = _flat(batch.column(3))
            held = told.place[held]
            w, _ = _mixtures(rows[held >= 0], held[held >= 0], batch.num_rows, share, q)
            # every sentence is a document that begins at the mixture of the one it stands in
            heard = q[place] > 0
            mixed = _sentence_mixtures(sentence[heard], place[heard], w[owner] + PRIOR, share, q)
            about = np.where(np.bincount(sentence[heard], minlength=len(owner)) > 0, mixed.argmax(axis=1), -1) if len(owner) else np.array([], dtype=np.int64)
            n = np.bincount(owner, minlength=batch.num_rows)
            out_row, out_subject, out_share = [], [], []
            for j in range(k):
                part = np.bincount(owner[about == j], minlength=batch.num_rows)
                for i in np.flatnonzero((part > 0) & (part * 1.0 >= least * n - 1e-9)):
                    out_row.append(int(i))
                    out_subject.append(subjects[j])
                    out_share.append(float(part[i] / n[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out_row, pa.int64())), pa.array(out_subject, pa.string()), pa.array(out_share, pa.float64())], names=["key", "subject", "share"])

    return sentences


def subject_shares(df: DataFrame, keys: DataFrame, labels: DataFrame, key: str = "doc_number", text: str = "text", mark: str | None = "section", least: float = 1 / 3, rounds: int = ROUNDS) -> DataFrame:
    """key, subject, share of every subject that at least ``least`` of a document's sentences are about.

    ``keys``: subject and words (parted by spaces); ``labels``: key and subject as raters gave them, repeats by one rater
    count once and only a document's most frequent subjects are used.  ``mark`` is a column of unreliable marks (sections):
    each value is one more term of the document, for its mixture only; it says as much as it is found to say.

    The driver holds one row of weights for each column, at most 2 ** TERM_BITS whatever the size of ``df``.
    """
    from folioflow.plans.lineage import settle, spread

    spark = df.sparkSession
    topics = keys.where("subject is not null and words is not null").select("subject", "words").collect()
    subjects = sorted({r["subject"] for r in topics})
    k = len(subjects)
    src = df.where(F.col(text).rlike(r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]")).select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(mark).cast("string") if mark else F.lit(None).cast("string")).alias("mark"))
    kind = dict(src.dtypes)["key"]
    read = settle(spread(src).mapInArrow(_read, f"key {kind}, tongue int, lengths array<int>, terms array<int>, once array<int>"))
    by_tongue = read.select("tongue", "once").mapInArrow(_spread, "tongue long, term long, n long").groupBy("tongue", "term").agg(F.sum("n").alias("n"))
    enough = by_tongue.where("term >= 0").groupBy("term").agg(F.sum("n").alias("n"), F.max(F.struct("n", "tongue")).alias("m")).where(F.col("n") >= MIN_DOCUMENTS)
    top = enough.select("term", "n", "m.tongue").toPandas().sort_values("term")
    columns, n_docs = top["term"].to_numpy(int), top["n"].to_numpy(float)
    factors = Factors(columns, np.zeros((len(columns), max(1, k))), np.unique(top["tongue"].to_numpy(int), return_inverse=True)[1])
    place = factors.told(SMOOTH).place
    # seeds: what part of the topics that name a word belong to each subject
    for r in topics:
        at = place[_hash([w.lower() for w in r["words"].split()])]
        factors.weights[at[at >= 0], subjects.index(r["subject"])] += 1.0
    named = factors.weights.sum(axis=1, keepdims=True)
    factors.weights = np.where(named > 0, factors.weights / np.maximum(named, 1) * n_docs[:, None], factors.weights)
    votes = labels.where(F.col("subject").isin(subjects)).select(F.col(key).alias("key"), "subject", "rater").distinct().groupBy("key", "subject").count()
    best = votes.groupBy("key").agg(F.max("count").alias("most"))
    top = votes.join(best, "key").where("count = most").groupBy("key").agg(F.collect_set("subject").alias("s"))
    code = F.transform("s", lambda x: (F.array_position(F.array(*[F.lit(s) for s in subjects]), x) - 1).cast("int"))
    shared = spark.sparkContext.broadcast(factors.told(SMOOTH))
    held = read.select("key", "once").mapInArrow(_presence(shared), f"key {kind}, held array<int>")
    rated = settle(held.join(top.select("key", code.alias("given")), "key", "left").select("held", F.coalesce("given", F.array().cast("array<int>")).alias("given")))
    smooth = SMOOTH
    for turn in range(rounds if k else 0):
        # from the middle on, only columns that are at least a quarter as uneven as telling ones are updated
        shared = spark.sparkContext.broadcast(factors.told(smooth, TELLING / 4 if turn >= rounds // 2 else -1.0))
        rows = rated.mapInArrow(_update(shared, k), "at int, w array<double>")
        sums = rows.groupBy("at").agg(*[F.sum(F.col("w")[j]).alias(f"w{j}") for j in range(k)]).toPandas()
        weights = factors.weights.copy() if turn >= rounds // 2 else np.zeros_like(factors.weights)
        weights[sums["at"].to_numpy(int)] = sums[[f"w{j}" for j in range(k)]].to_numpy(float)
        factors, smooth = Factors(columns, weights, factors.home), FIRST_SMOOTH if turn < rounds // 2 else SMOOTH
        shared.destroy()
    shared = spark.sparkContext.broadcast(factors.told(smooth, TELLING / 2))
    if not k:
        return spark.createDataFrame([], f"{key} {kind}, subject string, share double")
    out = read.select("key", "lengths", "terms", "once").mapInArrow(_decide(shared, subjects, least), f"key {kind}, subject string, share double")
    return out.groupBy(F.col("key").alias(key), "subject").agg(F.max("share").alias("share"))


def corpus_shares(shares: DataFrame) -> DataFrame:
    """subject, documents, share: the subjects' parts of all documents with a subject; a document of several counts in parts."""
    each = shares.groupBy("doc_number").agg(F.count(F.lit(1)).alias("k"))
    parts = shares.join(each, "doc_number").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(1 / F.col("k")).alias("weight"))
    total = parts.agg(F.sum("weight")).scalar()
    return parts.select("subject", "documents", (F.col("weight") / total).alias("share"))
