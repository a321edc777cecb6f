"""Queries of the corpus algebra, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.operators import corpus as C, records as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT min(doc_id) AS min_id, max(doc_id) AS max_id FROM documents")
def id_range(s, d):
    return C.id_range(table(s, d, "documents"), "doc_id")


@query("SELECT trim(split_part(coalesce(section, ''), ';', 1)) AS value, count(*) AS n FROM documents GROUP BY 1")
def tally_first_piece(s, d):
    return C.tally(table(s, d, "documents"), "section")


@query("SELECT source, count(*) AS n, min(pub_ts::DATE) AS first_day, max(pub_ts::DATE) AS last_day, count(DISTINCT pub_ts::DATE) AS days FROM documents GROUP BY 1")
def source_date_ranges(s, d):
    return C.source_dates(table(s, d, "documents"), "source", F.to_date("pub_ts"))


@query("SELECT DISTINCT source, pub_ts::DATE AS day, dayname(pub_ts::DATE) AS weekday FROM documents")
def source_distinct_dates(s, d):
    return table(s, d, "documents").select("source", F.to_date("pub_ts").alias("day"), F.date_format("pub_ts", "EEEE").alias("weekday")).distinct()


@query("SELECT month, day, count(*) AS n FROM doc WHERE year = 2001 GROUP BY ALL")
def counts_by_month_day(s, d):
    """Articles of one year by month and day."""
    return table(s, d, "doc").where("year = 2001").groupBy("month", "day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT year, count(*) AS n FROM doc GROUP BY 1")
def counts_by_year(s, d):
    return table(s, d, "doc").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT len(string_split(text, '.'))::BIGINT AS s, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))::BIGINT AS w FROM documents WHERE length(text) > 0)
    SELECT count(*) AS articles, sum(s)::BIGINT AS sentences, sum(w)::BIGINT AS words, round(sum(s)::DOUBLE / count(*), 6) AS mean_sentences, round(sum(w)::DOUBLE / count(*), 6) AS mean_words FROM t""")
def sentence_word_stats(s, d):
    return C.text_figures(table(s, d, "documents"), "text")


@query("SELECT doc_id, source, lang FROM documents")
def project_columns(s, d):
    return C.keep(table(s, d, "documents"), ["doc_id", "source", "lang"])


@query("SELECT doc_id, source, 1 AS kept FROM documents")
def keep_with_flag(s, d):
    return C.keep(table(s, d, "documents"), ["doc_id", "source"], "kept")


@query("SELECT * EXCLUDE (text, pub_ts, load_ts) FROM documents")
def drop_columns(s, d):
    return table(s, d, "documents").drop("text", "pub_ts", "load_ts")


@query("SELECT DISTINCT doc_number, source FROM df WHERE doc_number IN (SELECT doc_number FROM labels WHERE rater > 3)")
def rows_by_flag(s, d):
    return C.by_ids(table(s, d, "df").select("doc_number", "source").distinct(), table(s, d, "labels").where("rater > 3"), "doc_number")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def row_slice(s, d):
    return C.window_of_rows(table(s, d, "documents").select("doc_id", "source"), ["doc_id"], 20, 50)


@query("SELECT doc_id, source FROM documents WHERE doc_id % 100 < 25")
def hash_sample(s, d):
    return C.hash_sample(table(s, d, "documents").select("doc_id", "source"), "doc_id", 25, 100)


@query()
def fraction_sample(s, d):
    return C.fraction(table(s, d, "documents").select("doc_id"), 0.2, 7)


@query("SELECT DISTINCT doc_number, section FROM df WHERE doc_number IN (SELECT doc_number FROM labels)")
def subset_by_id(s, d):
    return C.by_ids(table(s, d, "df").select("doc_number", "section").distinct(), table(s, d, "labels"), "doc_number")


@query("SELECT DISTINCT doc_number, section FROM df WHERE doc_number NOT IN (SELECT doc_number FROM labels)")
def exclude_by_id(s, d):
    return C.by_ids(table(s, d, "df").select("doc_number", "section").distinct(), table(s, d, "labels"), "doc_number", include=False)


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('Capstone Wire', 'Harbor Ledger')")
def drop_sources(s, d):
    return table(s, d, "documents").select("doc_id", "source").where(~F.col("source").isin("Capstone Wire", "Harbor Ledger"))


@query("SELECT subject, count(DISTINCT doc_number) AS n FROM labels GROUP BY 1")
def route_by_class(s, d):
    return table(s, d, "labels").groupBy("subject").agg(F.count_distinct("doc_number").alias("n"))


@query("SELECT coalesce(contains(lower(text), 'market'), false) AS has_phrase, count(*) AS n FROM documents GROUP BY 1")
def split_by_phrase(s, d):
    return table(s, d, "documents").groupBy(F.coalesce(C.holds("text", ["market"]), F.lit(False)).alias("has_phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT phrase, doc_id FROM documents, (VALUES ('bank'), ('judge'), ('senator')) v(phrase) WHERE contains(lower(text), phrase)")
def route_by_phrases(s, d):
    return C.route(table(s, d, "documents"), "text", ["bank", "judge", "senator"]).where("phrase <> 'none'").select("phrase", "doc_id")


@query("SELECT DISTINCT term_str, coalesce(term_str IN (SELECT unnest(string_split(words, ' ')) FROM topic_keys), false) AS listed FROM vocab WHERE term_str IS NOT NULL")
def partition_terms(s, d):
    words = table(s, d, "topic_keys").select(F.explode(F.split("words", " ")).alias("term_str")).distinct().withColumn("listed", F.lit(True))
    return table(s, d, "vocab").where("term_str is not null").select("term_str").distinct().join(words, "term_str", "left").fillna(False, ["listed"])


@query("SELECT DISTINCT doc_number, CASE WHEN doc_number IN (SELECT doc_number FROM labels) THEN 'train' ELSE 'test' END AS part FROM df")
def train_test_split(s, d):
    ids = table(s, d, "labels").select("doc_number").distinct().withColumn("part", F.lit("train"))
    return table(s, d, "df").select("doc_number").distinct().join(ids, "doc_number", "left").fillna("test", ["part"])


@query("SELECT doc_id, sentence_num, count(*) AS n FROM token WHERE doc_id IN (SELECT doc_id FROM token WHERE term_str = 'bank') GROUP BY ALL")
def select_any_part(s, d):
    return C.any_part(table(s, d, "token"), "doc_id", F.col("term_str") == "bank").groupBy("doc_id", "sentence_num").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT doc_number, source, year FROM df WHERE source IN ('Harbor Ledger', 'Capstone Wire') AND try_strptime(trim(year) || '-' || lower(trim(month)) || '-' || trim(num_day), '%Y-%B-%d')
    BETWEEN TIMESTAMP '2000-03-01' AND TIMESTAMP '2001-06-30'""")
def select_source_dates(s, d):
    day = C.date_of(F.col("year"), F.col("month"), F.col("num_day"))
    return table(s, d, "df").where(F.col("source").isin("Harbor Ledger", "Capstone Wire") & day.between("2000-03-01", "2001-06-30")).select("doc_number", "source", "year").distinct()


@query("""SELECT doc_id, coalesce(contains(lower(text), 'bank') OR contains(lower(text), 'fund'), false)::INTEGER AS money, coalesce(contains(lower(text), 'court'), false)::INTEGER AS court,
    coalesce(contains(lower(text), 'bank') OR contains(lower(text), 'fund'), false)::INTEGER + coalesce(contains(lower(text), 'court'), false)::INTEGER AS n_matches FROM documents""")
def keyword_flags(s, d):
    return C.phrase_flags(table(s, d, "documents").select("doc_id", "text"), "text", {"money": ["bank", "fund"], "court": ["court"]}).drop("text")


@query(r"""SELECT doc_id, regexp_matches(lower(text), '\bteach[0-9A-Za-z_-]*\b|\bpupil\b') AS school FROM documents WHERE text IS NOT NULL""")
def regex_spec_flags(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.lower("text").rlike(C.search_pattern(["teach*", "pupil"])).alias("school"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS new_id FROM documents")
def renumber(s, d):
    return C.renumber(table(s, d, "documents").select("doc_id"), "doc_id").withColumn("new_id", F.col("new_id").cast("long"))


@query("SELECT doc_id + 1000 AS doc_id, source FROM documents")
def increment_ids(s, d):
    return table(s, d, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "source")


@query("SELECT doc_id % 100 AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def undo_offset(s, d):
    return table(s, d, "documents").groupBy((F.col("doc_id") % 100).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT item_id + 100000000, lang FROM eval_items")
def combine_offset(s, d):
    return C.combine([table(s, d, "documents").select("doc_id", "lang"), table(s, d, "eval_items").select(F.col("item_id").alias("doc_id"), "lang")], "doc_id", 100000000)


@query("SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT item_id, 'items' FROM eval_items WHERE item_id NOT IN (SELECT doc_id FROM documents)")
def combine_first_wins(s, d):
    a = table(s, d, "documents").select("doc_id", F.lit("documents").alias("origin"))
    return C.first_wins([a, table(s, d, "eval_items").select(F.col("item_id").alias("doc_id"), F.lit("items").alias("origin"))], "doc_id")


@query("""SELECT (item_id - 1) // 4 AS group_id, string_agg(text, ' ' ORDER BY item_id) AS text FROM (SELECT row_number() OVER (ORDER BY item_id) AS item_id, text FROM eval_items)
    GROUP BY 1 HAVING count(*) = 4""")
def merge_every_n(s, d):
    items = C.renumber(table(s, d, "eval_items").select("item_id", "text"), "item_id", "k")
    return C.merge_every(items, "k", "text", 4).withColumn("group_id", F.col("group_id").cast("long"))


@query("SELECT docid, string_agg(sent_str, ' ' ORDER BY sentence_id, sent_str) AS sent_str FROM sents WHERE sent_str IS NOT NULL AND docid IS NOT NULL GROUP BY 1 UNION ALL SELECT docid, sent_str FROM sents WHERE sent_str IS NOT NULL AND docid IS NULL")
def merge_parts(s, d):
    return C.join_parts(table(s, d, "sents").where("sent_str is not null"), "docid", "sentence_id", "sent_str")


@query("""SELECT o_custkey, value_1, value_2 FROM (SELECT o_custkey, sum(o_orderkey)::BIGINT AS value_1 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    FULL JOIN (SELECT o_custkey, sum(o_orderkey)::BIGINT AS value_2 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)""")
def combine_files_sum(s, d):
    o = table(s, d, "orders").withColumn("value", F.col("o_orderkey"))
    return C.merge_columns(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey", "value", "sum")


@query("""SELECT o_custkey, value_1, value_2 FROM (SELECT o_custkey, max(o_orderkey) AS value_1 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    FULL JOIN (SELECT o_custkey, max(o_orderkey) AS value_2 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)""")
def combine_files_max(s, d):
    o = table(s, d, "orders").withColumn("value", F.col("o_orderkey"))
    return C.merge_columns(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey", "value", "max")


@query("SELECT DISTINCT doc_number FROM df WHERE doc_number NOT IN (SELECT doc_number FROM labels)")
def ids_lost(s, d):
    return C.lost_ids(table(s, d, "df"), table(s, d, "labels"), "doc_number")


@query("SELECT doc_id, year, month, day FROM doc")
def sort_by_date(s, d):
    return table(s, d, "doc").select("doc_id", "year", "month", "day").orderBy("year", "month", "day", "doc_id")


@query("SELECT doc_id, 3 * 10000000 + (year - 1940) * 100000 + month * 1000 + day * 10 + 1 AS packed FROM doc")
def packed_ids(s, d):
    return table(s, d, "doc").select("doc_id", C.packed_id(F.lit(3), F.col("year"), F.col("month"), F.col("day"), F.lit(1)).alias("packed"))


@query("SELECT doc_id, dayname(make_date(year, month, day)) AS weekday FROM doc")
def weekday_names(s, d):
    return table(s, d, "doc").select("doc_id", F.date_format(F.make_date("year", "month", "day"), "EEEE").alias("weekday"))


@query("""SELECT month, list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(trim(month)))::INTEGER AS month_nr, count(*) AS n
    FROM df GROUP BY 1, 2""")
def month_numbers(s, d):
    return table(s, d, "df").groupBy("month", C.month_number(F.col("month")).alias("month_nr")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (NOT coalesce(regexp_full_match(trim(year), '[+-]?[0-9]+') AND try_cast(trim(year) AS INTEGER) IS NOT NULL, false)) AS bad_year,
    count(*) FILTER (NOT coalesce(regexp_full_match(trim(num_day), '[+-]?[0-9]+') AND try_cast(trim(num_day) AS INTEGER) IS NOT NULL, false)) AS bad_day FROM df""")
def bad_date_counts(s, d):
    """Years and days of all rows that are no whole number; null is none."""
    whole = table(s, d, "df").select(F.trim("year").try_cast("int").alias("y"), F.trim("num_day").try_cast("int").alias("n"))
    return whole.agg(F.count_if(F.col("y").isNull()).alias("bad_year"), F.count_if(F.col("n").isNull()).alias("bad_day"))


@query("""SELECT doc_number, load_ts::DATE AS load_day, last_value(section IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_number, load_ts ROWS UNBOUNDED PRECEDING) AS section FROM df WHERE source IS NOT NULL""")
def forward_fill_meta(s, d):
    return C.fill_forward(table(s, d, "df").where("source is not null"), ["source"], ["doc_number", "load_ts"], ["section"]).select("doc_number", F.to_date("load_ts").alias("load_day"), "section")


@query(r"SELECT doc_id, regexp_extract(text, '[^\s\x{0B}\pZ\x{1C}-\x{1F}\x{85}]+') AS first_word FROM documents WHERE text IS NOT NULL")
def length_first_word(s, d):
    """First word of every text, parted by any blank; empty where the text is blank."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.regexp_extract("text", r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]+", 0).alias("first_word"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r.]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) >= 20""")
def word_counts(s, d):
    return C.word_counts(table(s, d, "documents"), "text", 20)


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r.]+'), lambda w: w <> '') AS w FROM documents),
    g AS (SELECT unnest([w[i] || '_' || w[i + 1] || '_' || w[i + 2] for i in range(1, len(w) - 1)]) AS gram FROM t)
    SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 20""")
def ngram_counts(s, d):
    return C.ngram_counts(table(s, d, "documents"), "text", 3, 20)


@query("SELECT doc_id, lang FROM documents EXCEPT SELECT doc_id, 'en' FROM documents")
def except_rows(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", "lang").subtract(t.select("doc_id", F.lit("en").alias("lang")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM doc")
def intersect_ids(s, d):
    return table(s, d, "documents").select("doc_id").intersect(table(s, d, "doc").select("doc_id"))


@query("SELECT doc_key, count(*) AS n FROM doc GROUP BY 1 HAVING count(*) > 1")
def doc_key_multiplicity(s, d):
    return table(s, d, "doc").groupBy("doc_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT section, count(*) AS n FROM token GROUP BY 1")
def section_counts(s, d):
    return table(s, d, "token").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT doc_number FROM df WHERE section IN ('International', 'Economy', 'Technology', 'Politics & Policy', 'Law')")
def reduce_sections(s, d):
    return table(s, d, "df").where(F.col("section").isin("International", "Economy", "Technology", "Politics & Policy", "Law")).select("doc_number").distinct()


@query("SELECT count(*) AS n, sum((reason = 'year')::INTEGER)::BIGINT AS year FROM (SELECT CASE WHEN NOT coalesce(regexp_full_match(trim(year), '[0-9]{4}') AND try_cast(year AS INT) BETWEEN 1999 AND 2002, false) THEN 'year' END AS reason FROM df)")
def bad_years(s, d):
    t = R.split_dates(table(s, d, "df"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.col("reason"), F.lit("")) == "year").cast("long")).alias("year"))
