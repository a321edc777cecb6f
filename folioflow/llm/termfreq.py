"""Frequency of every distinct term (problem 3).

Tokens are range-partitioned and sorted by their place (record, sentence, token), so that every
record is one run of rows and a record or place with very many rows may span partitions.  One
pass keeps, for each term, a last-seen counter: occurrences, records, and the first and last
place; a record counts when it differs from the term's last.  The counters of neighbouring
partitions are merged by comparing the last place of one with the first of the next.  No set of
records is ever built, and the only rows shuffled twice are one counter per term and partition.

Defined cases: tokens without a record id, and repeated rows for one place, do not count (the
least term of a place counts); a null term counts as part of its record only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

_COUNTERS = "part int, term string, occ long, recs long, d0 long, s0 int, t0 int, d1 long, s1 int, t1 int"


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    # term -> [occurrences, records, first place (3), last place (3)]; None counts the records themselves
    state: dict[str | None, list[int]] = {}
    last_place = None
    for batch in batches:
        if not batch.num_rows:
            continue
        d, s, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        if last_place == (d[0], s[0], t[0]):
            new[0] = False
        last_place = (d[-1], s[-1], t[-1])
        rows = np.flatnonzero(new)
        if not len(rows):
            continue
        terms = batch.column(3).take(pa.array(rows)).dictionary_encode()
        names = [*terms.dictionary.to_pylist(), None]
        codes = terms.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        d, s, t = d[rows], s[rows], t[rows]
        for code, name, record_only in [(codes, names, False), (np.zeros(len(d), dtype=np.int64), [None], True)]:
            order = np.argsort(code, kind="stable")
            c, dd, ss, tt = code[order], d[order], s[order], t[order]
            starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            ends = np.r_[starts[1:], len(c)]
            changes = np.r_[True, (dd[1:] != dd[:-1]) | (c[1:] != c[:-1])]
            records = np.add.reduceat(changes.astype(np.int64), starts)
            for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())):
                key = name[c[a]]
                if (key is None) != record_only:
                    continue
                first, last = (int(dd[a]), int(ss[a]), int(tt[a])), (int(dd[z - 1]), int(ss[z - 1]), int(tt[z - 1]))
                known = state.get(key)
                if known is None:
                    state[key] = [z - a, int(records[i]), *first, *last]
                else:
                    known[0] += z - a
                    known[1] += int(records[i]) - (known[5] == first[0])
                    known[5:8] = last
    if state:
        columns = list(zip(*state.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(state), pa.int32()), pa.array(list(state), pa.string())]
            + [pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()])],
            names=["part", "term", "occ", "recs", "d0", "s0", "t0", "d1", "s1", "t1"],
        )


def term_counts(df: DataFrame, term: str = "term_str", record: str = "doc_id", sentence: str = "sentence_num", token: str = "token_num") -> DataFrame:
    """term, occurrences, records of every distinct term; the row with a null term holds all tokens and records."""
    from folioflow.plans.lineage import settle

    src = df.where(F.col(record).isNotNull()).select(
        F.col(record).cast("long").alias("d"), F.coalesce(F.col(sentence).cast("int"), F.lit(-1)).alias("s"), F.coalesce(F.col(token).cast("int"), F.lit(-1)).alias("t"),
        F.col(term).cast("string").alias("w"),
    )
    # copies of one place may fill many partitions, in order: the partition they come from breaks the tie
    place = src.withColumn("p", F.spark_partition_id()).repartitionByRange("d", "s", "t", "w", "p").sortWithinPartitions("d", "s", "t", "w").drop("p")
    # one counter a term and partition, used for the terms and for the total: kept, so that the tokens are read once
    counters = settle(place.mapInArrow(_last_seen, _COUNTERS))
    w = Window.partitionBy("term").orderBy("part")
    same_record = F.coalesce(F.lag("d1").over(w) == F.col("d0"), F.lit(False))
    same_place = same_record & (F.lag("s1").over(w) == F.col("s0")) & (F.lag("t1").over(w) == F.col("t0"))
    merged = counters.select("term", (F.col("occ") - same_place.cast("int")).alias("occ"), (F.col("recs") - same_record.cast("int")).alias("recs"))
    return merged.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("recs").alias("records"))


def mark_terms(counts: DataFrame, rare: int = 2, common: tuple[int, int] = (2, 3)) -> DataFrame:
    """The terms of ``counts`` with mark: 'rare' in at most ``rare`` records, 'common' in more than ``common`` of all, else null."""
    everything = counts.where(F.col("term").isNull()).agg(F.max("records").alias("n")).scalar()
    share = F.col("records") * common[1] > everything * common[0]
    mark = F.when(F.col("records") <= rare, F.lit("rare")).when(share, F.lit("common"))
    return counts.where(F.col("term").isNotNull()).withColumn("mark", mark)


def words_only(token: DataFrame) -> DataFrame:
    """Rows of a token table that are words of a known article."""
    return token.where(F.col("doc_id").isNotNull() & (F.col("punc") == 0) & (F.col("num") == 0))


def correct_vocab(vocab: DataFrame, marked: DataFrame) -> DataFrame:
    """vocab with one row a term: n counted over the whole collection, p its share of all words, stop the majority of the
    given flags (a common term is one, too; ties and no flags: only if common), mark and records as counted.

    Terms of vocab that never occur get n 0; terms that vocab lacks are added with a null term_id.
    """
    flag = vocab.where(F.col("term_str").isNotNull()).groupBy("term_str").agg(
        F.min("term_id").alias("term_id"), F.min("port_stem").alias("port_stem"),
        (F.sum(F.when(F.col("stop") == 1, 1).when(F.col("stop") == 0, -1).otherwise(0)) > 0).alias("_stop"),
    )
    total = marked.agg(F.sum("occurrences")).scalar()
    out = flag.join(marked.withColumnRenamed("term", "term_str"), "term_str", "full")
    n = F.coalesce("occurrences", F.lit(0))
    return out.select(
        "term_id", "term_str", n.alias("n"), (n / total).alias("p"), F.coalesce("records", F.lit(0)).alias("records"), "port_stem",
        (F.coalesce("_stop", F.lit(False)) | F.coalesce(F.col("mark") == "common", F.lit(False))).cast("int").alias("stop"), "mark",
    )
