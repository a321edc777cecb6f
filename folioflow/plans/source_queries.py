"""Queries that write tables out and read them back: what comes back is held against what went out."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import corpus as C, dedup
from folioflow.plans.registry import registry, table
from folioflow.sources import files as S, vendors

QUERIES, ORACLES, query = registry()


@query("SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(s, d):
    """Texts with quotes, commas, line breaks, nulls and empty strings, through delimited files."""
    path = S.write_csv(table(s, d, "documents").select("doc_id", "text", "lang", "source"), S.new_folder(s, "csv"))
    return S.read_csv(s, path, "doc_id long, text string, lang string, source string")


@query("SELECT item_id, lang FROM eval_items")
def csv_without_header(s, d):
    path = S.write_csv(table(s, d, "eval_items").select("item_id", "lang"), S.new_folder(s, "csv"), header=False)
    return S.read_csv(s, path, "_a long, _b string", header=False, names=["item_id", "lang"])


@query("SELECT doc_id, 1 + (item_id IS NOT NULL)::INTEGER AS times FROM documents LEFT JOIN eval_items ON item_id = doc_id")
def csv_appended(s, d):
    """A table written in two turns, the second behind the first: documents, then those whose id is an item's."""
    docs = table(s, d, "documents").select("doc_id")
    path = S.write_csv(docs, S.new_folder(s, "csv"))
    S.write_csv(C.by_ids(docs, table(s, d, "eval_items").select(F.col("item_id").alias("doc_id")), "doc_id"), path, mode="append")
    return S.read_csv(s, path, "doc_id long").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("SELECT doc_id::VARCHAR AS id, text FROM documents WHERE text IS NOT NULL")
def id_texts(s, d):
    """Files of id and text whose first row is a heading."""
    rows = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    headed = s.createDataFrame([("doc id", "text")], "id string, text string").unionByName(rows)
    return S.read_id_texts(s, S.write_csv(headed, S.new_folder(s, "idtext"), header=False))


@query("SELECT item_id AS id, coalesce(text, '') AS text FROM (SELECT DISTINCT item_id FROM eval_items) LEFT JOIN (SELECT doc_id AS item_id, text FROM documents) USING (item_id)")
def id_texts_subset(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.texts_of(docs, table(s, d, "eval_items").select(F.col("item_id").alias("id")))


@query(r"SELECT regexp_replace(section, '^\s+|\s+$', '', 'g') AS section FROM df")
def one_column(s, d):
    return S.one_column(table(s, d, "df"), "section")


@query("SELECT DISTINCT term_str AS word FROM vocab WHERE trim(term_str) <> ''")
def word_list_round_trip(s, d):
    words = table(s, d, "vocab").select("term_str").where("term_str is not null").distinct()
    return S.read_words(s, S.write_words(words, "term_str", S.new_folder(s, "words")))


_CELLS = r"""SELECT row_no, list_filter([trim(c) FOR c IN string_split(regexp_replace(line_text, '^\x{FEFF}', ''), ',')], lambda c: c <> '') AS cells FROM raw_rows
    WHERE line_text IS NOT NULL AND NOT starts_with(ltrim(regexp_replace(line_text, '^\x{FEFF}', '')), '#')"""


@query(f"WITH c AS ({_CELLS}) SELECT row_no, array_to_string(cells, '|') AS cells FROM c WHERE len(cells) > 0")
def clean_rows(s, d):
    lines = table(s, d, "raw_rows").where("line_text is not null")
    return S.clean_rows(lines, "line_text", keep=["row_no"]).withColumn("cells", F.array_join("cells", "|"))


@query("SELECT topic, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM (SELECT topic, string_split(words, ' ') AS w FROM topic_keys) WHERE len(w) > 1")
def first_and_rest(s, d):
    rows = table(s, d, "topic_keys").select("topic", F.split("words", " ").alias("cells"))
    return S.first_and_rest(rows, keep=["topic"]).withColumn("rest", F.array_join("rest", " "))


@query("SELECT year, month, count(*) AS n FROM doc WHERE year = 2001 AND month IN (3, 4) GROUP BY 1, 2")
def table_by_month(s, d):
    """Months of a table parted by year and month: only their folders are read."""
    path = S.write_by_month(table(s, d, "doc"), S.new_folder(s, "months"))
    return S.read_months(s, path, "year = 2001 and month in (3, 4)").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


_BAG = "SELECT doc_id, term_id, count(*) AS n FROM (SELECT DISTINCT ON (doc_id, sentence_num, token_num) doc_id, term_id FROM token WHERE doc_id IS NOT NULL AND punc = 0 AND num = 0 ORDER BY doc_id, sentence_num, token_num, term_id) GROUP BY 1, 2"


@query(_BAG)
def features_round_trip(s, d):
    from folioflow.plans.vector_queries import counts

    return S.read_features(s, S.write_features(counts(s, d), S.new_folder(s, "features")))


@query("""SELECT count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'edge') AS edges FROM (SELECT DISTINCT 'node' AS kind, subject AS a, NULL AS b FROM labels UNION ALL SELECT DISTINCT 'node', doc_number::VARCHAR, NULL FROM labels
    UNION ALL SELECT DISTINCT 'edge', doc_number::VARCHAR, subject FROM labels)""")
def graph_file(s, d):
    """Articles and their subjects as a graph file, read back as lines."""
    edges = table(s, d, "labels").select(F.col("doc_number").cast("string").alias("x"), F.col("subject").alias("y"), F.lit(1.0).alias("overlap")).distinct()
    lines = s.read.text(S.write_graph(edges, S.new_folder(s, "graph")))
    return lines.agg(F.count_if(F.startswith("value", F.lit("<node id="))).alias("nodes"), F.count_if(F.startswith("value", F.lit("<edge "))).alias("edges"))


@query("SELECT count(DISTINCT file_name) AS files, count(*) AS lines FROM raw_rows WHERE line_text IS NOT NULL")
def folder_of_texts(s, d):
    """One text file for each file name, found and read again under numbers; line breaks are blanks by then."""
    lines = table(s, d, "raw_rows").where("line_text is not null").select("file_name", "row_no", F.regexp_replace("line_text", r"[\r\n]", " ").alias("value"))
    path = S.new_folder(s, "texts")
    lines.repartition("file_name").sortWithinPartitions("file_name", "row_no").select("file_name", "value").write.partitionBy("file_name").text(path)
    found = S.list_files(s, path, ".txt").agg(F.countDistinct(F.regexp_extract("path", "file_name=([^/]+)", 1)).alias("files"))
    return found.withColumn("lines", s.read.option("recursiveFileLookup", "true").text(path).agg(F.count(F.lit(1))).scalar())


@query("""WITH t AS (SELECT doc_number, source, coalesce(year, '') || '-' || coalesce(month, '') || '-' || coalesce(num_day, '') AS day, coalesce(title, '') AS title, coalesce(text, '') AS text FROM (SELECT DISTINCT ON (doc_number) * FROM df ORDER BY doc_number, load_ts)),
    r AS (SELECT *, text[1:200] AS head, CASE WHEN length(title) > 32 THEN title[1:50] END AS name FROM t),
    m AS (SELECT *, min(doc_number) OVER (PARTITION BY source, day, head) AS h, min(doc_number) OVER (PARTITION BY source, day, name) AS n, min(doc_number) OVER (PARTITION BY source, day) AS f, arg_min(text, doc_number) OVER (PARTITION BY source, day) AS ft FROM r)
    SELECT doc_number, (head <> '' AND doc_number > h) OR (name IS NOT NULL AND doc_number > n) OR (head <> '' AND doc_number > f AND contains(ft, head)) AS duplicate FROM m""")
def ingest_dedup(s, d):
    """Articles of a source and day that the same source has delivered before."""
    one = table(s, d, "df").groupBy("doc_number").agg(F.min_by(F.struct("source", "year", "month", "num_day", "title", "text"), "load_ts").alias("r")).select("doc_number", "r.*")
    day = F.concat_ws("-", *[F.coalesce(c, F.lit("")) for c in ("year", "month", "num_day")])
    rows = one.select("doc_number", "source", day.alias("day"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return dedup.delivered_again(rows, "source", "day", "doc_number", "title", "text").select("doc_number", "duplicate")


@query()
def dedup_day(s, d):
    """Articles nearly the same as one kept before them on their day."""
    day = C.date_of(F.col("year"), F.col("month"), F.col("num_day"))
    return dedup.duplicates_of_day(table(s, d, "df").withColumn("day", day), "doc_number", "day", "title", "text")


@query("""SELECT source, contains(lower(source), 'blogs') OR contains(lower(source), '.co') OR contains(lower(source), 'law') OR lower(source) NOT IN ('wall street journal', 'boston globe', 'tampa bay times', 'star-tribune', 'new york times', 'washington post', 'usa today',
    'atlanta journal-constitution', 'philadelphia inquirer', 'denver post', 'daily news', 'new york post', 'san jose mercury news', 'harbor ledger') AS skipped, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2""")
def skipped_sources(s, d):
    """Sources left out by a list of those wanted and by what their names hold; one of these tables' sources is on the list."""
    out = table(s, d, "documents").where("source is not null")
    return out.groupBy("source", vendors.skipped(F.col("source"), only=(*vendors.US_SOURCES, "harbor ledger")).alias("skipped")).agg(F.count(F.lit(1)).alias("n"))
