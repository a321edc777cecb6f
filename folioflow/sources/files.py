"""Plain files in and out: delimited tables, lists of words, folders of texts, tables by month, features, graphs.

Readers are lazy scans; writers write a folder, as Spark does.  Delimited files are quoted with ``"``,
doubled inside, and may hold line breaks in quotes.
"""

from __future__ import annotations

import uuid
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NULL = r"\N"
_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, beside the checkpoints."""
    from folioflow.plans.lineage import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- delimited tables ---------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", null: str = NULL) -> str:
    """All columns as text; nulls are written as ``null``, so that they and empty strings both come back."""
    df.write.mode(mode).options(**_CSV, header=str(header).lower(), nullValue=null, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, names: list[str] | None = None, null: str = NULL) -> DataFrame:
    """A delimited table; ``names`` are given to the columns of files without a header.  What is written as ``null`` is null."""
    reader = spark.read.options(**_CSV, header=str(header).lower(), nullValue=null, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*names) if names else df


def read_id_texts(spark: SparkSession, path: str) -> DataFrame:
    """id and text of two-column files without a header; rows whose first cell holds "id" are one and are left out."""
    rows = read_csv(spark, path, "id string, text string", header=False)
    return rows.where(~F.coalesce(F.contains(F.lower("id"), F.lit("id")), F.lit(False)))


def texts_of(texts: DataFrame, ids: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Every id asked for with its text, empty where there is none."""
    return ids.select(key).distinct().join(texts.select(key, text), key, "left").select(key, F.coalesce(text, F.lit("")).alias(text))


def one_column(df: DataFrame, column: str) -> DataFrame:
    """A column without blanks around its values."""
    return df.select(F.regexp_replace(column, r"^\s+|\s+$", "").alias(column))


def clean_rows(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and cells of every line that is neither blank nor a comment (#): without blanks around, without empty ones, without a byte order mark."""
    cells = F.transform(F.split(F.regexp_replace(line, "^﻿", ""), ","), lambda c: F.trim(c))
    rows = lines.select(*(keep or []), F.filter(cells, lambda c: c != "").alias("cells"), F.ltrim(F.regexp_replace(line, "^﻿", "")).alias("_l"))
    return rows.where((F.size("cells") > 0) & ~F.startswith("_l", F.lit("#"))).drop("_l")


def first_and_rest(rows: DataFrame, cells: str = "cells", keep: list[str] | None = None) -> DataFrame:
    """``keep``, first cell and the rest of every row of at least two."""
    return rows.where(F.size(cells) > 1).select(*(keep or []), F.col(cells)[0].alias("first"), F.slice(cells, 2, F.size(cells) - 1).alias("rest"))


# ---- words and texts ----------------------------------------------------------------------------------------------


def write_words(df: DataFrame, word: str, path: str) -> str:
    df.select(word).write.mode("overwrite").text(path)
    return path


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, without blanks around; empty lines are none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv", leave_out: str | None = None) -> DataFrame:
    """path and size of all files under a folder with a suffix, but those whose path holds ``leave_out``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", F.col("length").alias("size"))
    return files.where(~F.contains("path", F.lit(leave_out))) if leave_out else files


def read_texts(spark: SparkSession, folder: str, fold: bool = True) -> DataFrame:
    """number (from 0, by path), path and text of all .txt files under a folder; line breaks are blanks, accents are taken off."""
    from folioflow.functions.text import ascii_fold
    from folioflow.operators.corpus import renumber

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    text = F.regexp_replace("value", r"\r\n|\n|\r", " ")
    out = files.select(F.input_file_name().alias("path"), (ascii_fold(text) if fold else text).alias("text"))
    return renumber(out, "path", "number").withColumn("number", F.col("number") - 1)


# ---- tables by month, features, graphs ------------------------------------------------------------------------------


def write_by_month(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet parted by the columns year and month; readers of some months read only their folders."""
    df.repartition("year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)
    return path


def read_months(spark: SparkSession, path: str, condition: str = "true") -> DataFrame:
    return spark.read.parquet(path).where(condition)


def write_features(bow: DataFrame, path: str, doc: str = "doc_id", term: str = "term_id", value: str = "n") -> str:
    """Sparse rows (terms and values of a document in order) as Parquet."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(term).alias("i"), F.col(value).alias("v"))))
    bow.groupBy(doc).agg(cells.alias("c")).select(doc, F.col("c.i").alias("terms"), F.col("c.v").alias("vals")).write.mode("overwrite").parquet(path)
    return path


def read_features(spark: SparkSession, path: str, doc: str = "doc_id", term: str = "term_id", value: str = "n") -> DataFrame:
    return spark.read.parquet(path).select(doc, F.inline(F.arrays_zip(F.col("terms").alias(term), F.col("vals").alias(value))))


def graph_lines(edges: DataFrame, x: str = "x", y: str = "y", weight: str = "overlap") -> DataFrame:
    """place, line: the edges as a GEXF file, a line a row; ``place`` gives the order (head, nodes, edges, foot)."""
    spark = edges.sparkSession
    quoted = lambda c: F.concat(F.lit('"'), _escaped(c), F.lit('"'))
    nodes = edges.select(F.col(x).cast("string").alias("v")).unionByName(edges.select(F.col(y).cast("string").alias("v"))).distinct()
    node = nodes.select(F.lit(1).alias("place"), F.concat(F.lit("<node id="), quoted(F.col("v")), F.lit(" label="), quoted(F.col("v")), F.lit("/>")).alias("line"))
    edge = edges.select(
        F.lit(3).alias("place"),
        F.concat(F.lit("<edge source="), quoted(F.col(x).cast("string")), F.lit(" target="), quoted(F.col(y).cast("string")), F.lit(" weight="), quoted(F.col(weight).cast("string")), F.lit("/>")).alias("line"),
    )
    frame = [(0, f'<gexf xmlns={quoteattr("http://www.gexf.net/1.2draft")} version="1.2"><graph defaultedgetype="undirected"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    return spark.createDataFrame(frame, "place int, line string").unionByName(node).unionByName(edge)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graph(edges: DataFrame, path: str, **names: str) -> str:
    """The graph as one sorted folder of text files; joined in order they are the file."""
    graph_lines(edges, **names).orderBy("place", "line").select("line").write.mode("overwrite").text(path)
    return path
