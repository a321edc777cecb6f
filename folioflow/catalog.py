"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators import records
from folioflow.plans import cleaning_queries, content_queries, corpus_queries, feature_queries, preparation_queries, signal_queries, source_queries, string_queries, text_queries, vector_queries

_PARTS = (corpus_queries, cleaning_queries, text_queries, vector_queries, signal_queries, string_queries, source_queries, content_queries, feature_queries, preparation_queries)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The reason of a line is that of its first record; records found behind a broken one do not mend the line."""
    lines = records.parse_records(_t(spark, d, "raw_rows"), "line_text").where("record_no = 0 and reason is not null").select(F.lit("raw_rows").alias("table_name"), F.col("row_no").alias("row_key"), "reason")
    dates = records.split_dates(_t(spark, d, "df").select("doc_number", "year", "month", "num_day")).where("reason is not null").select(F.lit("df").alias("table_name"), F.col("doc_number").alias("row_key"), "reason")
    return lines.unionByName(dates).distinct()


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows of raw_rows, loaded."""
    return records.parse_records(_t(spark, d, "raw_rows"), "line_text").where("reason is null").select("row_no", "file_name", "record.*")


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """Records of every file by their reason (null: valid), the lines of a file read as one text, a thousand row numbers at a time."""
    lines = _t(spark, d, "raw_rows").where("line_text is not null").withColumn("block", F.floor(F.col("row_no") / 1000))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line_text"))), lambda r: r["line_text"])
    files = lines.groupBy("file_name", "block").agg(F.array_join(ordered, "\n").alias("text"))
    return records.parse_records(files, "text", whole=False).groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_found": p7_found, "p7_valid": p7_valid, "p7_files": p7_files} | {k: f for part in _PARTS for k, f in part.QUERIES.items()}


_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_DATE_FAULT = """CASE WHEN NOT coalesce(regexp_full_match(y, '[0-9]{4}') AND try_cast(y AS INT) BETWEEN 1999 AND 2002, false) THEN 'year'
    WHEN NOT coalesce(lower(m) IN ('january','february','march','april','may','june','july','august','september','october','november','december'), false) THEN 'month'
    WHEN NOT coalesce(regexp_full_match(d, '[0-9]{1,2}') AND try_strptime(y || ' ' || m || ' ' || d, '%Y %B %d') IS NOT NULL, false) THEN 'day' END"""
_LINES = f"""lines AS (SELECT row_no, rtrim(line_text, chr(13) || chr(10)) AS t FROM raw_rows),
    cut AS (SELECT row_no, t, regexp_extract(t, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD}', ['f1', 'f2', 'f3', 'f4']) AS f,
    length(regexp_replace(t, '"([^"]|"")*"', 'q', 'g')) - length(replace(regexp_replace(t, '"([^"]|"")*"', 'q', 'g'), ',', '')) + 1 AS n FROM lines),
    parts AS (SELECT row_no, t, n, trim(trim(f.f2, '"'), chr(32) || chr(9)) AS y, trim(trim(f.f3, '"'), chr(32) || chr(9)) AS m, trim(trim(f.f4, '"'), chr(32) || chr(9)) AS d FROM cut),
    raws AS (SELECT row_no, CASE WHEN NOT regexp_full_match(t, '{_FIELD}(,{_FIELD})*') THEN 'quoting' WHEN t IS NULL OR n <> 8 THEN 'column_count' ELSE {_DATE_FAULT} END AS reason FROM parts)"""

_NAMES = ("docid", "year", "month", "num_day", "weekday", "title", "text", "section")
_CELLS = ", ".join(f"CASE WHEN starts_with(v.{c}, '\"') THEN replace(v.{c}[2:-2], '\"\"', '\"') ELSE v.{c} END AS {c}" for c in _NAMES)
ORACLES: dict[str, str] = {
    "p7_found": f"""WITH {_LINES}, dated AS (SELECT doc_number, trim(year, chr(32) || chr(9)) AS y, trim(month, chr(32) || chr(9)) AS m, trim(num_day, chr(32) || chr(9)) AS d FROM df)
        SELECT DISTINCT 'raw_rows' AS table_name, row_no AS row_key, reason FROM raws WHERE reason IS NOT NULL
        UNION SELECT 'df', doc_number, {_DATE_FAULT} FROM dated WHERE {_DATE_FAULT} IS NOT NULL""",
    "p7_valid": f"""WITH {_LINES}, good AS (SELECT row_no, file_name, regexp_extract(rtrim(line_text, chr(13) || chr(10)), '^{",".join([_FIELD] * 8)}$', {list(_NAMES)}) AS v FROM raw_rows JOIN raws USING (row_no) WHERE reason IS NULL)
        SELECT row_no, file_name, {_CELLS} FROM good""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {k: q for part in _PARTS for k, q in part.ORACLES.items()}
