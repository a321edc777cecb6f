"""Queries of page marks, stems and long texts."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from folioflow.functions import pages, porter
from folioflow.functions.strings import column
from folioflow.plans.vector_queries import table
from folioflow.sources.vendors import split_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT section, nullif(upper(coalesce(nullif(regexp_extract(section, '(?i)\bsection ([a-z])\b', 1), ''), regexp_extract(section, '^([A-Za-z])[0-9]+$', 1))), '') AS letter,
    coalesce(try_cast(nullif(regexp_extract(section, '(?i)\b(?:page|pg\.?|p\.) ?([0-9]+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(section, '^[A-Za-z]([0-9]+)$', 1), '') AS INTEGER), -101) AS page,
    try_cast(nullif(regexp_extract(section, '(?i)\bcolumn ([0-9]+)', 1), '') AS INTEGER) AS page_column, count(*) AS n FROM documents WHERE section IS NOT NULL GROUP BY ALL""")
def page_number(s, d):
    m = F.col("section")
    t = table(s, d, "documents").where("section is not null")
    return t.groupBy("section", pages.section_letter(m).alias("letter"), pages.page(m).alias("page"), pages.page_column(m).alias("page_column")).agg(F.count(F.lit(1)).alias("n"))


@query()
def porter_stems(s, d):
    terms = table(s, d, "vocab").where("term_str is not null").select("term_str").distinct()
    return terms.withColumn("stem", column(porter.stem, T.StringType())("term_str"))


@query("SELECT doc_id, text AS joined FROM documents WHERE text IS NOT NULL")
def split_long_text(s, d):
    """Texts cut into parts of five hundred characters and joined again: the texts."""
    parts = column(lambda t: split_text(t, 500), T.ArrayType(T.StringType()))
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(parts("text")).alias("part", "piece"))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("joined"))


@query("SELECT doc_number, min(load_ts)::DATE AS load_day FROM df GROUP BY 1")
def first_delivery(s, d):
    """Articles delivered more than once, once: the first delivery counts."""
    return table(s, d, "df").groupBy("doc_number").agg(F.to_date(F.min("load_ts")).alias("load_day"))
