"""Tokens, vocabulary and the vector space, always in long form (document, term, value), never pivoted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def split_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token_num (from 0), token_str: runs of letters or digits and single other marks; blanks of any kind part tokens and are none."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}\x{1C}-\x{1F}\x{85}]"), F.lit(0))
    return df.select(key, F.posexplode(tokens).alias("token_num", "token_str"))


def flag_tokens(df: DataFrame) -> DataFrame:
    """With punc, num and term_str (lower case, without quotes, underscores, stars and points; null for punctuation and numbers)."""
    punc = F.col("token_str").rlike(r"^[^\p{L}\p{M}\p{N}]*$").cast("int")
    num = F.col("token_str").rlike("[0-9]").cast("int")
    term = F.when((punc == 0) & (num == 0), F.regexp_replace(F.lower("token_str"), "[\"_*.]", ""))
    return df.withColumn("punc", punc).withColumn("num", num).withColumn("term_str", term)


def flag_tokens_strict(df: DataFrame) -> DataFrame:
    """With term_str in the later form: also without apostrophes, slashes, digits, blanks and hyphens."""
    return flag_tokens(df).withColumn("term_str", F.regexp_replace("term_str", r"[\"'_*.\\/0-9\s-]", ""))


def vocabulary(tokens: DataFrame, term: str = "term_str") -> DataFrame:
    """term_str, n, p of every distinct term."""
    counts = tokens.where(F.col(term).isNotNull()).groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / counts.agg(F.sum("n")).scalar())


def bag(tokens: DataFrame, doc: str = "doc_id", term: str = "term_id") -> DataFrame:
    """doc, term, n."""
    return tokens.where(F.col(doc).isNotNull() & F.col(term).isNotNull()).groupBy(doc, term).agg(F.count(F.lit(1)).alias("n"))


def tf_idf(bow: DataFrame, doc: str = "doc_id", term: str = "term_id") -> DataFrame:
    """doc, term, tf (share of the document), df, idf (log10 of documents over df), f."""
    total = bow.groupBy(doc).agg(F.sum("n").alias("doc_n"))
    spread = bow.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    docs = total.agg(F.count(F.lit(1))).scalar()
    out = bow.join(total, doc).join(spread, term).withColumn("tf", F.col("n") / F.col("doc_n")).withColumn("idf", F.log10(docs / F.col("df")))
    return out.withColumn("f", F.col("tf") * F.col("idf"))


def tf_idf_smoothed(bow: DataFrame, doc: str = "doc_id", term: str = "term_id", alpha: float = 1e-6) -> DataFrame:
    """term, df, tf_sum, tf_max of the smoothed share (n + alpha) / (length + alpha * terms) over the dense grid, absent terms in closed form."""
    length = bow.groupBy(doc).agg(F.sum("n").alias("l"))
    spread = bow.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    terms = spread.agg(F.count(F.lit(1))).scalar()
    rest = length.agg(F.sum(1 / (F.col("l") + alpha * terms))).scalar()
    most = length.agg(F.max(1 / (F.col("l") + alpha * terms))).scalar()
    part = bow.join(length, doc).withColumn("x", F.col("n") / (F.col("l") + alpha * terms)).withColumn("y", (F.col("n") + alpha) / (F.col("l") + alpha * terms))
    out = part.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum("x").alias("x"), F.max("y").alias("y"))
    return out.select(term, "df", (F.col("x") + alpha * rest).alias("tf_sum"), F.greatest("y", alpha * most).alias("tf_max"))


def tf_idf_stats(bow: DataFrame, stop: DataFrame, terms: Column | int, doc: str = "doc_id", term: str = "term_id", alpha: float = 1e-6) -> DataFrame:
    """term, df, idf (log2 of documents over df), and sum, mean and max of smoothed share times idf, of terms that are no stop words.

    The share is (n + alpha) / (length + alpha * ``terms``) over the dense grid; absent terms are added in closed form.
    """
    length = bow.groupBy(doc).agg(F.sum("n").alias("l"))
    docs = length.agg(F.count(F.lit(1))).scalar()
    rest, most = length.agg(F.sum(1 / (F.col("l") + alpha * terms))).scalar(), length.agg(F.max(1 / (F.col("l") + alpha * terms))).scalar()
    kept = bow.join(stop.select(term).distinct(), term, "left_anti").join(length, doc)
    out = kept.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("n") / (F.col("l") + alpha * terms)).alias("x"), F.max((F.col("n") + alpha) / (F.col("l") + alpha * terms)).alias("y"))
    idf = F.log2(docs / F.col("df"))
    total = (F.col("x") + alpha * rest) * idf
    return out.select(term, "df", idf.alias("idf"), total.alias("tfidf_sum"), (total / docs).alias("tfidf_mean"), (F.greatest("y", alpha * most) * idf).alias("tfidf_max"))


def restrict(weights: DataFrame, terms: DataFrame, term: str = "term_id") -> DataFrame:
    """The weights of the terms given."""
    return weights.join(terms.select(term).distinct(), term, "left_semi")


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, missing: int = -1) -> DataFrame:
    """``df`` with the table's value for its key, ``missing`` where there is none; a key is taken with its least value."""
    one = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_v"))
    return df.join(one, key, "left").withColumn(value, F.coalesce("_v", F.lit(missing))).drop("_v")


# ---- features of texts: fitted on one part, applied to another -----------------------------------------------------


def feature_rows(df: DataFrame, key: str, text: str, shortest: int = 1, longest: int = 1) -> DataFrame:
    """key, feature at every place: runs of words of at least two letters, digits or underscores, in lower case."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    return df.select(key, words.alias("w")).select(key, F.explode(F.flatten(F.array(*[runs(n) for n in range(shortest, longest + 1)]))).alias("feature"))


def count_features(df: DataFrame, key: str, text: str, shortest: int = 1, longest: int = 1, binary: bool = False) -> DataFrame:
    """key, feature, n of all features (``feature_rows``)."""
    out = feature_rows(df, key, text, shortest, longest).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("n", F.lit(1).cast("long")) if binary else out


def count_fitted(df: DataFrame, key: str, text: str, fitted: DataFrame, shortest: int = 1, longest: int = 1) -> DataFrame:
    """key, feature_id, n of the fitted features alone; the others are dropped where they are found, before anything is counted.

    The fitted features are sent to the texts: each is in a share ``least`` of the training documents, so there are at most
    1 / ``least`` times as many as a training document has on the average, however many documents there are.
    """
    rows = feature_rows(df, key, text, shortest, longest).join(F.broadcast(fitted.select("feature", "feature_id")), "feature")
    return rows.groupBy(key, "feature_id").agg(F.count(F.lit(1)).alias("n"))


def fit_features(counts: DataFrame, docs: Column | int, least: float, most: float, key: str) -> DataFrame:
    """feature, feature_id (from 0, by name) and df of the features in at least a share ``least`` and at most ``most`` of the documents."""
    from folioflow.operators.corpus import renumber

    spread = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least * docs) & (F.col("df") <= most * docs))
    return renumber(spread, "feature", "feature_id").withColumn("feature_id", (F.col("feature_id") - 1).cast("long"))


def apply_features(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """The counts of fitted features, with feature_id."""
    return counts.join(fitted, "feature")


def apply_variance(bow: DataFrame, variance: DataFrame, term: str = "term_id") -> DataFrame:
    """Counts times the variance of their terms as fitted elsewhere; terms not fitted are left out."""
    return bow.join(variance.select(term, "variance"), term).withColumn("weight", F.col("n") * F.col("variance"))


def fit_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: least and greatest of every column."""
    return df.agg(*[f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.min, "low"), (F.max, "high"))])


def scale_by(df: DataFrame, bounds: DataFrame, columns: list[str], whole: bool = False) -> DataFrame:
    """Columns scaled by fitted bounds and held to 0..1, rounded to 0 or 1 where ``whole``; a column of one value is only held."""
    out = df
    for c in columns:
        low, high = bounds.select(f"{c}_low").scalar(), bounds.select(f"{c}_high").scalar()
        x = F.when(high == low, F.col(c).cast("double")).otherwise((F.col(c) - low) / (high - low))
        out = out.withColumn(c, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(x) if whole else x)))
    return out


def combine_features(frames: list[DataFrame], key: str, feature: str = "feature_id", fitted: dict[int, DataFrame] | None = None) -> DataFrame:
    """Feature sets of the same keys side by side: the k-th set's features come behind those of the sets before it.

    fitted: by a set's place the features that it was fitted with, each of which occurs in it; so its counts need not be made to number them.
    """
    from functools import reduce

    named = [(fitted or {}).get(k, f) for k, f in enumerate(frames[:-1])]
    wide = [f.agg(F.coalesce(F.max(feature), F.lit(-1)) + 1).scalar() for f in named]
    out, offset = [], F.lit(0)
    for f, n in zip(frames, [*wide, F.lit(0)]):
        out.append(f.withColumn(feature, F.col(feature) + offset))
        offset = offset + n
    return reduce(DataFrame.unionByName, out)


def vectorize(
    texts: DataFrame, train: DataFrame, key: str, text: str, counting: str = "scaled", weighting: str = "tfidf", least: float = 0.01, most: float = 0.5, shortest: int = 1, longest: int = 1,
) -> DataFrame:
    """key, feature_id, weight: features of ``texts``, all of them fitted on those whose keys are in ``train``.

    counting: 'binary', 'count', 'scaled' (over the greatest count of the training part) or 'augmented' (0.5 + 0.5 of the
    text's greatest); weighting: 'none', 'tfidf' (ln((1 + N) / (1 + df)) + 1, rows of length 1) or 'variance'.
    """
    every = count_features(texts, key, text, shortest, longest, counting == "binary")
    keys = train.select(key).distinct()
    docs = texts.join(keys, key, "left_semi").agg(F.count(F.lit(1))).scalar()
    fit = fit_features(every.join(keys, key, "left_semi"), docs, least, most, key)
    bow = apply_features(every, fit).select(key, "feature_id", F.col("n").cast("double").alias("n"), "df")
    if counting == "scaled":
        bow = bow.withColumn("n", F.col("n") / bow.join(keys, key, "left_semi").agg(F.max("n")).scalar())
    elif counting == "augmented":
        bow = augmented_counts(bow, key).drop("n").withColumnRenamed("augmented", "n")
    if weighting == "variance":
        variance = term_variance(bow.join(keys, key, "left_semi"), key, "feature_id")
        return apply_variance(bow, variance, "feature_id").select(key, "feature_id", "weight")
    if weighting == "none":
        return bow.select(key, "feature_id", F.col("n").alias("weight"))
    raw = bow.withColumn("w", F.col("n") * (F.log((1 + docs) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "feature_id", (F.col("w") / F.col("norm")).alias("weight"))


def bounds_of(bow: DataFrame, by: str, value: str = "n", others: Column | int | None = None) -> DataFrame:
    """by, low, high of sparse values; where fewer than ``others`` cells are given, the rest are 0."""
    out = bow.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("_n"))
    if others is not None:
        out = out.withColumn("low", F.when(F.col("_n") < others, F.least("low", F.lit(0))).otherwise(F.col("low"))).withColumn("high", F.when(F.col("_n") < others, F.greatest("high", F.lit(0))).otherwise(F.col("high")))
    return out.drop("_n")


def _products(wide: int):  # noqa: ANN202
    """Sums of products of features over a task's rows, a row of the matrix each."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((wide, wide))
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                dense = np.zeros((len(part), wide))
                for r, (i, v) in enumerate(zip(part["i"], part["v"])):
                    dense[r, i] = v
                gram += dense.T @ dense
        yield pd.DataFrame({"row": range(wide), "sums": [g.tobytes() for g in gram]})

    return add


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [pdf["row"].iat[0]], "sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})


def reduce_dimensions(bow: DataFrame, k: int, doc: str = "doc_id", term: str = "term_id", unit: bool = True) -> DataFrame:
    """doc and features: documents in the ``k`` greatest singular directions of the matrix, each scaled to 0..1, then to length 1.

    One pass sums up the products of features; what is decomposed is the matrix of terms by terms, so ``bow`` is to be
    restricted to some thousand terms before.
    """
    from pyspark.ml.feature import MinMaxScaler, Normalizer
    from pyspark.ml.functions import array_to_vector

    from folioflow.operators.corpus import renumber
    from folioflow.plans.lineage import settle

    places = renumber(bow.select(term).distinct(), term, "_i")
    cells = F.array_sort(F.collect_list(F.struct((F.col("_i") - 1).cast("int").alias("i"), F.col("n").cast("double").alias("v"))))
    rows = settle(bow.join(places, term).groupBy(doc).agg(cells.alias("c")).select(doc, F.col("c.i").alias("i"), F.col("c.v").alias("v")))
    wide = places.count()
    gram = np.zeros((wide, wide))
    for r in rows.select("i", "v").mapInPandas(_products(wide), "row int, sums binary").groupBy("row").applyInPandas(_sum_rows, "row int, sums binary").toLocalIterator():
        gram[r["row"]] = np.frombuffer(r["sums"])
    basis = np.linalg.eigh(gram)[1][:, ::-1][:, : min(k, wide)].copy()

    @F.pandas_udf("array<double>")
    def project(terms: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([(v @ basis[np.asarray(i, dtype=int)]).tolist() for i, v in zip(terms, values)])

    out = rows.select(doc, array_to_vector(project("i", "v")).alias("raw"))
    scaled = MinMaxScaler(inputCol="raw", outputCol="features").fit(out).transform(out).select(doc, "features")
    return Normalizer(inputCol="features", outputCol="unit").transform(scaled).select(doc, F.col("unit").alias("features")) if unit else scaled


def tf_idf_unit(bow: DataFrame, doc: str = "doc_id", term: str = "term_id") -> DataFrame:
    """doc, term, f: n * (ln((1 + docs) / (1 + df)) + 1), each document scaled to length 1."""
    spread = bow.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    docs = bow.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    raw = bow.join(spread, term).withColumn("w", F.col("n") * (F.log((1 + docs) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, doc).select(doc, term, (F.col("w") / F.col("norm")).alias("f"))


def scaled_counts(bow: DataFrame) -> DataFrame:
    """n over the greatest n of all."""
    return bow.withColumn("scaled", F.col("n") / bow.agg(F.max("n")).scalar())


def augmented_counts(bow: DataFrame, doc: str = "doc_id") -> DataFrame:
    """0.5 + 0.5 * n over the document's greatest n."""
    most = bow.groupBy(doc).agg(F.max("n").alias("most"))
    return bow.join(most, doc).withColumn("augmented", 0.5 + 0.5 * F.col("n") / F.col("most")).drop("most")


def term_variance(bow: DataFrame, doc: str = "doc_id", term: str = "term_id") -> DataFrame:
    """term, variance: sum over all documents of the squared distance of the term's rate from its mean rate, over the greatest."""
    length = bow.groupBy(doc).agg(F.sum("n").alias("l"))
    docs = length.agg(F.count(F.lit(1))).scalar()
    rate = bow.join(length, doc).withColumn("r", F.col("n") / F.col("l"))
    sums = rate.groupBy(term).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q")).withColumn("v", F.col("q") - F.col("s") * F.col("s") / docs)
    return sums.select(term, (F.col("v") / sums.agg(F.max("v")).scalar()).alias("variance"))


#: Documents of a block; a term counts as dense in a pair of blocks if one pair of documents in so many shares it; terms and products taken at once.
BLOCK, DENSE, AT_ONCE, PRODUCTS = 2048, 100, 512, 2_000_000


def _packed(size: int):  # noqa: ANN202
    """Up to ``size`` documents of a batch to one row: keys, ends of their terms, terms and counts, and every term once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                docs, terms, ns = batch.slice(at, size).columns
                every = terms.flatten()
                cells = [docs, pa.array(np.cumsum(terms.value_lengths().to_numpy()), pa.int32()), every, ns.flatten(), every.unique()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.list_(c.type)) for c in map(_whole, cells)], names=["docs", "ends", "terms", "ns", "distinct"])

    return pack


def _whole(c: pa.Array) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _units(row: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the document, weight) of every term of a block, documents scaled to length 1; those of no weight at all get NaN."""
    at = np.repeat(np.arange(len(row["docs"])), np.diff(row["ends"], prepend=0))
    order = np.argsort(row["known"])
    v = row["ns"] * row["idf"][order][np.searchsorted(row["known"], row["terms"], sorter=order)]
    with np.errstate(invalid="ignore"):
        return at, v / np.sqrt(np.bincount(at, v * v, len(row["docs"])))[at]


def _block_product(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Cosines of the documents of two blocks: terms that many of both have by matrix product, the others by their places."""
    shared = np.intersect1d(x["known"], y["known"])
    sides = []
    for b in (x, y):
        at, u = _units(b)
        place = np.searchsorted(shared, b["terms"])
        held = np.flatnonzero(place < len(shared))
        held = held[shared[place[held]] == b["terms"][held]]
        sides.append((at[held], u[held], place[held], np.bincount(place[held], minlength=len(shared))))
    nx, ny = len(x["docs"]), len(y["docs"])
    dense = sides[0][3] * sides[1][3] * DENSE > nx * ny
    rank = np.where(dense, np.cumsum(dense) - 1, -1)
    out = np.zeros((nx, ny))
    for low in range(0, int(dense.sum()), AT_ONCE):
        part = []
        for n, (at, u, place, _) in zip((nx, ny), sides):
            r = rank[place]
            those = (r >= low) & (r < low + AT_ONCE)
            m = np.zeros((n, AT_ONCE))
            m[at[those], r[those] - low] = u[those]
            part.append(m)
        out += part[0] @ part[1].T
    (at_x, u_x, p_x), (at_y, u_y, p_y) = [(at[~dense[place]], u[~dense[place]], place[~dense[place]]) for at, u, place, _ in sides]
    by_place = np.argsort(p_y, kind="stable")
    at_y, u_y = at_y[by_place], u_y[by_place]
    many = np.bincount(p_y, minlength=len(shared))
    first, each = (np.cumsum(many) - many)[p_x], many[p_x]
    cuts = np.flatnonzero(np.diff(np.cumsum(each) // PRODUCTS, prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(each)]):
        n = each[low:high]
        which = np.repeat(np.arange(low, high), n)
        other = np.repeat(first[low:high] - np.cumsum(n) + n, n) + np.arange(len(which))
        top, end = at_x[low], at_x[high - 1] + 1
        out[top:end] += np.bincount((at_x[which] - top) * ny + at_y[other], u_x[which] * u_y[other], (end - top) * ny).reshape(-1, ny)
    return out


def _cosines(least: float, digits: int | None):  # noqa: ANN202
    """(doc_x, doc_y, cosine) in either order of what two blocks have above ``least``; NaN counts as above, as in SQL."""
    names = ("docs", "ends", "terms", "ns", "known", "idf")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = ({n: batch.column(f"{n}_{side}")[i].values.to_numpy(zero_copy_only=False) for n in names} | {"block": batch.column(f"block_{side}")[i].as_py()} for side in "xy")
                cosine, same = _block_product(x, y), x["block"] == y["block"]
                if same:
                    np.fill_diagonal(cosine, -np.inf)
                for at in range(0, len(cosine), 256):
                    part = cosine[at : at + 256]
                    r, c = np.nonzero(~(part <= least))
                    v = part[r, c]
                    v = v if digits is None else np.floor(v * 10**digits + 0.5) / 10**digits
                    a, b = x["docs"][at + r], y["docs"][c]
                    for left, right in [(a, b)] if same else [(a, b), (b, a)]:
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(v)], names=["doc_x", "doc_y", "cosine"])

    return pairs


def cosines(bow: DataFrame, least: float, digits: int | None = None, doc: str = "doc_id", term: str = "term_id", size: int = BLOCK) -> DataFrame:
    """doc_x, doc_y, cosine of the TF-IDF weights (``tf_idf``) of every document with every other, where it is above ``least``.

    Documents are packed into blocks kept in the shared folder, and every pair of blocks is multiplied in one task; so no
    product is shuffled, only counts and the blocks. The length of a document cancels out, so counts times idf will do.
    """
    from folioflow.plans.lineage import settle

    kinds = dict(bow.dtypes)
    rows = bow.groupBy(doc).agg(F.collect_list(F.struct(F.col(term).alias("t"), F.col("n").alias("n"))).alias("c")).select(doc, F.col("c.t").alias("t"), F.col("c.n").alias("n"))
    packed = rows.mapInArrow(_packed(size), f"docs array<{kinds[doc]}>, ends array<int>, terms array<{kinds[term]}>, ns array<{kinds['n']}>, distinct array<{kinds[term]}>")
    blocks = settle(packed.withColumn("block", F.monotonically_increasing_id()))
    docs = blocks.agg(F.sum(F.size("docs"))).scalar()
    spread = blocks.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    known = blocks.select("block", F.explode("distinct").alias("t")).join(spread, "t").select("block", F.struct("t", F.log10(docs / F.col("df")).alias("idf")).alias("k"))
    known = known.groupBy("block").agg(F.collect_list("k").alias("k")).select("block", F.col("k.t").alias("known"), F.col("k.idf").alias("idf"))
    full = blocks.drop("distinct").join(known, "block")
    x, y = (full.select(*[F.col(c).alias(f"{c}_{side}") for c in full.columns]) for side in "xy")
    return x.join(y, F.col("block_x") <= F.col("block_y")).mapInArrow(_cosines(least, digits), f"doc_x {kinds[doc]}, doc_y {kinds[doc]}, cosine double")


def top(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k rows with the greatest value, ties by the least ``tie``."""
    return df.orderBy(F.desc(value), F.asc(tie)).limit(k)


def top_each(df: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rescale(df: DataFrame, value: str, low: float, high: float, digits: int | None = None) -> DataFrame:
    """value between its bounds as a number from 0 to 1, rounded if wanted."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - low) / (high - low)))
    return df.withColumn("scaled", F.round(x, digits) if digits is not None else x)
