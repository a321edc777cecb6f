"""Corpus algebra: projections, filters, splits, ids, merges, counts and orders of article tables.

All are lazy and declarative.  Rows keep their columns unless said otherwise; nulls never match a
filter; counts ignore nothing but what their docstring names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of the months, in English and other languages.
FOREIGN_MONTHS = {
    "français": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "deutsch": "januar februar märz april mai juni juli august september oktober november dezember",
    "espanol": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "nederlands": "januari februari maart april mei juni juli augustus september oktober november december",
    "dansk": "januar februar marts april maj juni juli august september oktober november december", "italiano": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


# ---- projections -------------------------------------------------------------------------------------------------


def keep(df: DataFrame, columns: list[str], flag: str | None = None, value: object = 1) -> DataFrame:
    """The columns named, with a constant column ``flag`` if wanted."""
    out = df.select(*columns)
    return out.withColumn(flag, F.lit(value)) if flag else out


def word_count(*columns: str) -> Column:
    """Words parted by blanks of all columns together; null counts as empty."""
    each = [F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")) for c in columns]
    return reduce(lambda a, b: a + b, each)


def describe_columns(df: DataFrame) -> DataFrame:
    """position and name of every column."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, name string")


# ---- filters and splits -------------------------------------------------------------------------------------------


def by_ids(df: DataFrame, ids: DataFrame, key: str, include: bool = True) -> DataFrame:
    """Rows whose ``key`` is (or is not) in ``ids``; a null key is in no set."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if include else "left_anti")


def lost_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``before`` that ``after`` lacks."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def any_part(df: DataFrame, key: str, criterion: Column, include: bool = True) -> DataFrame:
    """All rows of every key of which any row meets the criterion (or of none)."""
    hits = df.where(criterion).select(key).distinct()
    return df.join(hits, key, "left_semi" if include else "left_anti")


def holds(text: str, phrases: list[str], caps: bool = False) -> Column:
    """Whether the text holds any of the phrases."""
    col = F.col(text) if caps else F.lower(text)
    return reduce(lambda a, b: a | b, [col.contains(p if caps else p.lower()) for p in phrases])


def search_pattern(keys: list[str]) -> str:
    """A pattern for whole words; ``*`` stands for the rest of a word."""
    return "|".join(r"\b" + re.sub(r"\\\*", r"[0-9A-Za-z_-]*", re.escape(k)) + r"\b" for k in keys)


def phrase_flags(df: DataFrame, text: str, flags: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column a word list, and n_matches, the number of lists found."""
    cols = {name: F.coalesce(holds(text, words).cast("int"), F.lit(0)) for name, words in flags.items()}
    out = df.withColumns(cols)
    return out.withColumn("n_matches", reduce(lambda a, b: a + b, [F.col(c) for c in cols]))


def route(df: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """A row for every phrase that a row holds (in any case), with the phrase; a row that holds none has phrase "none"."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))
    return df.withColumn("phrase", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))))


def route_by_number(df: DataFrame, value: str) -> DataFrame:
    """With part: the whole part of a number written as text, null where it is none."""
    return df.withColumn("part", F.col(value).cast("string").try_cast("double").cast("int"))


def write_parts(df: DataFrame, part: str, path: str) -> str:
    """One folder for each value of ``part``."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)
    return path


def by_mask(left: DataFrame, mask: DataFrame, order: str, mask_order: str, flag: str) -> DataFrame:
    """Rows whose place in their order is the place of a row of ``mask`` with a flag above 0 (two tables side by side)."""
    places = number_rows(mask, mask_order).where(F.col(flag) > 0).select(F.col("row_no").alias("_row"))
    rows = number_rows(left, order)
    return rows.join(places, rows["row_no"] == places["_row"], "left_semi").drop("row_no")


def side_by_side(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The rows of two tables with equal places in their orders; rows beyond the shorter one are left out."""
    return number_rows(left, left_order).join(number_rows(right, right_order), "row_no").drop("row_no")


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """With row_no from 1, in the order of a unique column."""
    return renumber(df, order, "row_no")


def criterion(column: str, kind: str, value: object) -> Column:
    """'matchstr' (equal text), 'matchval' (equal number), 'minthres' (at least), 'maxthres' (at most)."""
    number = F.col(column).cast("string").try_cast("double")
    tests = {"matchstr": lambda: F.col(column) == F.lit(value), "matchval": lambda: number == F.lit(value), "minthres": lambda: number >= F.lit(value), "maxthres": lambda: number <= F.lit(value)}
    return F.coalesce(tests[kind](), F.lit(False))


def hash_sample(df: DataFrame, key: str, part: int, of: int) -> DataFrame:
    """A sample by the remainder of the key, the same on every run."""
    return df.where(F.pmod(F.col(key), F.lit(of)) < part)


def fraction(df: DataFrame, part: float, seed: int) -> DataFrame:
    return df.sample(fraction=part, seed=seed)


def window_of_rows(df: DataFrame, order: list[str], start: int, n: int) -> DataFrame:
    """Rows ``start`` to ``start + n`` of the order."""
    return df.orderBy(*order).offset(start).limit(n)


# ---- ids ----------------------------------------------------------------------------------------------------------


def id_range(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("min_id"), F.max(key).alias("max_id"))


def renumber(df: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """Numbers 1.. in the order of a unique key.

    Ranges of the key are sorted in parallel and kept in the shared folder, with the range and the place in it as columns; so
    both readings of them are of one and the same cut.  Only the sizes of the ranges are summed up in one place.
    """
    from folioflow.plans.lineage import settle

    w = Window.partitionBy("_part").orderBy(key)
    ranged = df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged.withColumn("_at", F.row_number().over(w)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def combine(frames: list[DataFrame], key: str, offset: int) -> DataFrame:
    """Union in which the k-th frame's ids are raised by k * offset; ids of ``offset`` or more are an error."""
    raised = [f.withColumn(key, F.when(F.col(key) >= offset, F.raise_error(F.lit(f"id of {offset} or more"))).otherwise(F.col(key) + k * offset)) for k, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, raised)


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union with one row a key, of the first frame that has it."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_k", F.lit(k)) for k, f in enumerate(frames)])
    columns = [c for c in frames[0].columns if c != key]
    best = tagged.groupBy(key).agg(F.min_by(F.struct(*columns), "_k").alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def combine_apart(frames: list[DataFrame], key: str, least: bool = False) -> DataFrame:
    """Union in which the k-th frame's ids are raised by k times an offset that keeps all apart: a power of ten above every id
    (so that ids can be read off), or the greatest id and ten more where ``least``."""
    tops = reduce(DataFrame.unionByName, [f.agg(F.max(key).alias("m")) for f in frames])
    top = tops.agg(F.max("m")).scalar()
    offset = top + 10 if least else F.pow(F.lit(10), F.length(top.cast("string"))).cast("long")
    return reduce(DataFrame.unionByName, [f.withColumn(key, F.col(key) + k * offset).withColumn("corpus_no", F.lit(k)) for k, f in enumerate(frames)])


def append(main: DataFrame, parts: list[DataFrame], key: str, path: str, least: bool = False) -> str:
    """The main corpus and parts with ids apart written to a new folder; the main corpus stays as it is."""
    combine_apart([main, *parts], key, least).drop("corpus_no").write.mode("errorifexists").parquet(path)
    return path


def packed_id(source: Column, year: Column, month: Column, day: Column, part: Column) -> Column:
    return source * 10**7 + (year - 1940) * 10**5 + month * 10**3 + day * 10 + part


# ---- parts and merges ---------------------------------------------------------------------------------------------


def join_parts(df: DataFrame, key: str, part: str, text: str, separator: str = " ") -> DataFrame:
    """One row a key: its parts' texts in order.  Rows without a key are parts of nothing known and stay single."""
    known, single = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull()).select(key, text)
    ordered = F.array_sort(F.collect_list(F.struct(part, text)))
    return known.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r[text]), separator).alias(text)).unionByName(single)


def merge_every(df: DataFrame, number: str, text: str, n: int) -> DataFrame:
    """Every ``n`` rows in a row (by a number from 1) joined to one; a last group that is not full is left out."""
    group = F.floor((F.col(number) - 1) / n)
    ordered = F.array_sort(F.collect_list(F.struct(number, text)))
    out = df.groupBy(group.alias("group_id")).agg(F.array_join(F.transform(ordered, lambda r: r[text]), " ").alias(text), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == n).drop("_n")


def merge_tables(frames: list[tuple[DataFrame, str]], key: str, order: str, strict: bool = True) -> DataFrame:
    """Tables by key, one row a key: the columns of the first as they are, of the k-th with _k behind their names.

    Each table comes with how its parts are folded: 'max' or 'sum' (numbers), 'maxstr' (the last text), 'join' (texts one after
    another, by ``order``) or 'none' (the first part).  ``strict``: keys that are not in all tables are an error.
    """
    def fold(df: DataFrame, how: str, k: int) -> DataFrame:
        value = {
            "max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "maxstr": lambda c: F.max(F.col(c).cast("string")), "none": lambda c: F.min_by(c, order),
            "join": lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).cast("string").alias("v")))), lambda r: r["v"]), ""),
        }[how]
        return df.groupBy(key).agg(*[value(c).alias(f"{c}_{k}" if k else c) for c in df.columns if c not in (key, order)]).withColumn(f"_in_{k}", F.lit(1))

    out = reduce(lambda a, b: a.join(b, key, "full"), [fold(df, how, k) for k, (df, how) in enumerate(frames)])
    present = reduce(lambda a, b: a + b, [F.coalesce(f"_in_{k}", F.lit(0)) for k in range(len(frames))])
    if strict:
        out = out.withColumn(key, F.when(present < len(frames), F.raise_error(F.lit("keys differ between the tables"))).otherwise(F.col(key)))
    return out.drop(*[f"_in_{k}" for k in range(len(frames))])


def merge_columns(left: DataFrame, right: DataFrame, key: str, value: str, how: str) -> DataFrame:
    """Values of two tables by key, parts folded by ``how`` ('sum' or 'max'), suffixed _1 and _2."""
    def fold(df: DataFrame, k: int) -> DataFrame:
        return df.groupBy(key).agg(getattr(F, how)(value).alias(f"{value}_{k}"))

    return fold(left, 1).join(fold(right, 2), key, "full")


def fill_forward(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls replaced by the last value before them in their group.

    Rows are cut by ranges of group and order, so that a group of very many rows spans several; each range is filled by
    itself, and what it begins with comes from the last value of the group's ranges before it.
    """
    from folioflow.plans.lineage import settle

    by = [F.col(c) for c in (*group, *order)]
    ranged = settle(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns}
    ends = ranged.groupBy("_part", *group).agg(*last.values())
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.last(c, ignorenulls=True).over(before).alias(f"_c{i}") for i, c in enumerate(columns)])
    same = reduce(lambda a, b: a & b, [local[g].eqNullSafe(carried[f"_g{i}"]) for i, g in enumerate(group)], local["_part"] == carried["_p"])
    out = local.join(carried, same, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_c{columns.index(c)}")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


# ---- counts and orders --------------------------------------------------------------------------------------------


def tally(df: DataFrame, column: str) -> DataFrame:
    """Counts of the first piece (before ``;``) of a column."""
    return df.groupBy(F.trim(F.split(F.coalesce(F.col(column), F.lit("")), ";")[0]).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def source_dates(df: DataFrame, source: str, day: Column) -> DataFrame:
    """Articles, first and last day, and distinct days of every source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("days"))


def month_names(every: bool = False) -> dict[str, int]:
    """Numbers of the English names, or of all languages' (equal names have equal numbers)."""
    lists = [MONTHS, *[x.split() for x in FOREIGN_MONTHS.values()]] if every else [MONTHS]
    return {name: i + 1 for names in lists for i, name in enumerate(names)}


def month_number(name: Column, every: bool = False) -> Column:
    """1..12 of an English month's name (or of ``every`` language's) in any case, else null."""
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(low == m, F.lit(n)) for m, n in month_names(every).items()])


def date_of(year: Column, month: Column, day: Column, every: bool = False) -> Column:
    """The date, or null where there is no such day."""
    month_no = month_number(month, every)
    text = F.concat_ws("-", F.trim(year), F.lpad(month_no.cast("string"), 2, "0"), F.lpad(F.trim(day), 2, "0"))
    return F.when(F.trim(year).rlike("^[0-9]{4}$") & month_no.isNotNull() & F.trim(day).rlike("^[0-9]{1,2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def text_figures(df: DataFrame, text: str) -> DataFrame:
    """Articles with text, pieces between points, words, and their means."""
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\r]+"), lambda w: w != "")
    out = df.where(F.length(text) > 0).agg(
        F.count(F.lit(1)).alias("articles"), F.sum(F.size(F.split(F.col(text), "\\.", -1)).cast("long")).alias("sentences"), F.sum(F.size(words).cast("long")).alias("words")
    )
    return out.withColumn("mean_sentences", F.round(F.col("sentences") / F.col("articles"), 6)).withColumn("mean_words", F.round(F.col("words") / F.col("articles"), 6))


def part_figures(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row: articles, extra_parts (rows of an article behind its first), long_articles (those with extra parts), empty rows,
    sentences and words (of rows with words; a word of one character must be a letter or digit), and means by article."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\r]+"), lambda w: (F.length(w) > 1) | w.rlike("^[A-Za-z0-9]$"))
    rows = df.select(key, F.size(words).cast("long").alias("w"), F.when(F.size(words) > 0, F.size(F.split(F.col(text), "\\.", -1))).otherwise(0).cast("long").alias("s"))
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") == 0).alias("empty"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    out = each.agg(
        F.count_if(F.col("n") > F.col("empty")).alias("articles"), F.sum(F.col("n") - 1).alias("extra_parts"), F.count_if(F.col("n") > 1).alias("long_articles"),
        F.sum("empty").alias("empty"), F.sum("s").alias("sentences"), F.sum("w").alias("words"),
    )
    return out.withColumn("mean_sentences", F.round(F.col("sentences") / F.col("articles"), 6)).withColumn("mean_words", F.round(F.col("words") / F.col("articles"), 6))


def word_counts(df: DataFrame, text: str, least: int, leave_out: list[str] | None = None) -> DataFrame:
    """Words in lower case, parted by blanks and points, that occur at least ``least`` times."""
    word = F.explode(F.split(F.lower(F.col(text)), "[ \\t\\n\\r.]+")).alias("word")
    out = df.select(word).where("word <> ''")
    if leave_out:
        out = out.where(~F.col("word").isin(leave_out))
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def gram_counts(df: DataFrame, text: str, least: int, longest: int = 4, shortest: int = 1) -> DataFrame:
    """gram, size, n of runs of ``shortest`` to ``longest`` words that occur at least ``least`` times."""
    return reduce(DataFrame.unionByName, [ngram_counts(df, text, n, least).withColumn("size", F.lit(n)) for n in range(shortest, longest + 1)])


def ngram_counts(df: DataFrame, text: str, n: int, least: int) -> DataFrame:
    """Runs of ``n`` words joined by ``_`` that occur at least ``least`` times; a run never leaves its text."""
    words = F.filter(F.split(F.lower(F.col(text)), "[ \\t\\n\\r.]+"), lambda w: w != "")
    rows = df.select(words.alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), "_"))
    return rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
