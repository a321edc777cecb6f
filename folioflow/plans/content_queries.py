"""Queries of content filters, corpus merges and counts by parts, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import content as N, corpus as C, vectors as V
from folioflow.plans.registry import registry, table

QUERIES, ORACLES, query = registry()

# SQL of hits: places of a one-word phrase (a pattern of whole words) among the words of a text
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"
_PUNCT = "[.,;:!?]?"


def _places(pattern: str) -> str:
    return f"list_filter(range(1, len(w) + 1), lambda i: regexp_full_match(w[i], '{pattern}{_PUNCT}'))"


_HITS = f"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents), h AS (SELECT doc_id, w, {_places('bank[0-9A-Za-z_-]*')} AS found, {_places('river')} AS avoid FROM t),
    k AS (SELECT doc_id, w, list_filter(found, lambda i: NOT list_bool_or(list_transform(avoid, lambda a: abs(a - i) <= 5) || [false])) AS found FROM h)"""


@query(f"""WITH {_HITS}, x AS (SELECT doc_id, w, found, list_filter(range(1, len(w) + 1), lambda i: list_bool_or(list_transform(found, lambda f: i BETWEEN f - 3 AND f + 4) || [false])) AS kept FROM k WHERE len(found) > 0)
    SELECT doc_id, array_to_string(list_transform(kept, lambda i, n: (CASE WHEN n = 1 THEN '' WHEN kept[n - 1] = i - 1 THEN ' ' ELSE ' ... ' END) || w[i]), '') AS filtered, len(found)::INTEGER AS n_matches FROM x""")
def content_windows(s, d):
    """The words around every bank, unless a river is within five words."""
    return N.filter_by_content(table(s, d, "documents").select("doc_id", "text"), "text", ["bank*"], ["river"], 5, 3, 4).drop("text")


@query(f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), h AS (SELECT doc_id, {_places('judge')} AS f, {_places('court')} AS a, {_places('teach[0-9A-Za-z_-]*')} AS g FROM t), n AS (SELECT doc_id, len(f)::INTEGER AS law, len(g)::INTEGER AS school FROM h) SELECT doc_id, law, school, law + school AS n_matches FROM n WHERE law + school > 0")
def content_many(s, d):
    """Matches of several specifications side by side."""
    specs = {"law": (["judge"], []), "school": (["teach*"], [])}
    return N.filter_by_many(table(s, d, "documents").select("doc_id", "text"), "text", specs).drop("text", "filtered")


@query(f"""WITH t AS (SELECT doc_number, sentence_id, {_WORDS.replace('text', 'sent_str')} AS w FROM sents JOIN (SELECT DISTINCT docid, doc_number FROM df WHERE docid IS NOT NULL) USING (docid)),
    k AS (SELECT DISTINCT doc_number FROM t WHERE len({_places('storm')}) > 0) SELECT doc_number, count(*) AS parts FROM t JOIN k USING (doc_number) GROUP BY 1""")
def content_extract(s, d):
    """All parts of every article of which any part holds a storm."""
    ids = table(s, d, "df").where("docid is not null").select("docid", "doc_number").distinct()
    parts = table(s, d, "sents").join(ids, "docid").select("doc_number", "sentence_id", "sent_str")
    return N.extract_by_content(parts, "doc_number", "sent_str", ["storm"]).groupBy("doc_number").agg(F.count(F.lit(1)).alias("parts"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
    h AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: regexp_full_match(w[i], '(according|the)[.,;:!?]?') AND regexp_full_match(w[i + 1], CASE WHEN starts_with(w[i], 'a') THEN 'to' ELSE 'bank' END || '[.,;:!?]?'))) AS n FROM t) SELECT doc_id, n::INTEGER AS n_matches FROM h WHERE n > 0""")
def content_phrases(s, d):
    """Phrases of two words."""
    return N.filter_by_content(table(s, d, "documents").select("doc_id", "text"), "text", ["according to", "the bank"]).select("doc_id", "n_matches")


_DATES = "(SELECT doc_id, min(year) AS year, min(month) AS month, min(day) AS day FROM doc GROUP BY 1)"


@query("""WITH p AS (SELECT doc_id, sentence_num, count(*) AS n FROM token WHERE doc_id IS NOT NULL GROUP BY 1, 2) SELECT doc_id, count(*) AS parts FROM p WHERE doc_id IN (SELECT doc_id FROM p WHERE n >= 20) GROUP BY 1""")
def select_threshold(s, d):
    """Articles with a sentence of at least twenty tokens, all parts."""
    parts = table(s, d, "token").where("doc_id is not null").groupBy("doc_id", "sentence_num").agg(F.count(F.lit(1)).alias("n"))
    return C.any_part(parts, "doc_id", C.criterion("n", "minthres", 20)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT doc_number, count(*) AS n FROM df WHERE doc_number NOT IN (SELECT doc_number FROM df WHERE try_cast(num_day AS DOUBLE) <= 15) AND doc_number IS NOT NULL GROUP BY 1")
def select_threshold_outside(s, d):
    """Articles of which no delivery has a day up to the fifteenth."""
    return C.any_part(table(s, d, "df"), "doc_number", C.criterion("num_day", "maxthres", 15), include=False).groupBy("doc_number").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_number, count(*) AS n FROM df WHERE doc_number IN (SELECT doc_number FROM df WHERE section = 'Sports') GROUP BY 1")
def select_match(s, d):
    return C.any_part(table(s, d, "df"), "doc_number", C.criterion("section", "matchstr", "Sports")).groupBy("doc_number").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rater AS part, count(*) AS n FROM labels GROUP BY 1")
def route_to_folders(s, d):
    """Rows routed by a number to one folder each, and read again."""
    from folioflow.sources.files import new_folder

    path = C.write_parts(C.route_by_number(table(s, d, "labels"), "rater"), "part", new_folder(s, "parts"))
    return s.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT phrase, count(*) AS n FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE ['none'] END) AS phrase FROM (SELECT list_filter(['Bank', 'Judge', 'No such'], lambda p: contains(lower(coalesce(text, '')), lower(p))) AS f FROM documents)) GROUP BY 1")
def route_or_none(s, d):
    return C.route(table(s, d, "documents"), "text", ["Bank", "Judge", "No such"]).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.item_id, d.lang FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS r FROM eval_items) d JOIN (SELECT topic, alpha, row_number() OVER (ORDER BY topic) AS r FROM topic_keys) k USING (r) WHERE topic > 0")
def rows_by_mask(s, d):
    """Rows whose place is that of a flagged row of another table."""
    return C.by_mask(table(s, d, "eval_items").select("item_id", "lang"), table(s, d, "topic_keys").select("topic", F.col("topic").alias("flag")), "item_id", "topic", "flag")


@query("SELECT item_id, topic, subject FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM eval_items) JOIN (SELECT topic, subject, row_number() OVER (ORDER BY topic) AS r FROM topic_keys) USING (r)")
def side_by_side(s, d):
    return C.side_by_side(table(s, d, "eval_items").select("item_id"), table(s, d, "topic_keys").select("topic", "subject"), "item_id", "topic")


@query("WITH o AS (SELECT 1000000::BIGINT AS o) SELECT doc_id AS id, 0 AS corpus_no FROM documents UNION ALL SELECT item_id + (SELECT (10 ** length(greatest((SELECT max(doc_id) FROM documents), (SELECT max(item_id) FROM eval_items))::VARCHAR))::BIGINT), 1 FROM eval_items")
def combine_corpora_multi(s, d):
    return C.combine_apart([table(s, d, "documents").select(F.col("doc_id").alias("id")), table(s, d, "eval_items").select(F.col("item_id").alias("id"))], "id")


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT item_id + (SELECT greatest((SELECT max(doc_id) FROM documents), (SELECT max(item_id) FROM eval_items)) + 10) FROM eval_items")
def append_corpora(s, d):
    """A main corpus with another behind it, ids as near as they can be, through a new folder."""
    from folioflow.sources.files import new_folder

    frames = [table(s, d, "documents").select(F.col("doc_id").alias("id")), table(s, d, "eval_items").select(F.col("item_id").alias("id"))]
    return s.read.parquet(C.append(frames[0], frames[1:], "id", new_folder(s, "corpus"), least=True))


@query("""SELECT a.doc_number, days, subjects_1, raters_2 FROM (SELECT doc_number, max(load_ts)::DATE::VARCHAR AS days FROM df WHERE doc_number IN (SELECT doc_number FROM labels) GROUP BY 1) a
    JOIN (SELECT doc_number, string_agg(subject, '' ORDER BY rater, subject) AS subjects_1 FROM labels GROUP BY 1) b USING (doc_number) JOIN (SELECT doc_number, sum(rater)::BIGINT AS raters_2 FROM labels GROUP BY 1) c USING (doc_number)""")
def combine_files(s, d):
    """Three tables by key with parts folded as text, as joined text and as sums; keys must agree."""
    labels = table(s, d, "labels")
    days = C.by_ids(table(s, d, "df"), labels, "doc_number").select("doc_number", F.col("load_ts").alias("rater"), F.to_date("load_ts").cast("string").alias("days"))
    return C.merge_tables([(days, "maxstr"), (labels.select("doc_number", "rater", F.col("subject").alias("subjects")), "join"), (labels.select("doc_number", F.col("subject").alias("rater"), F.col("rater").cast("long").alias("raters")), "sum")], "doc_number", "rater")


@query(r"""WITH t AS (SELECT docid, len(list_filter(regexp_split_to_array(coalesce(sent_str, ''), '[ \t\n\r]+'), lambda w: length(w) > 1 OR regexp_full_match(w, '[A-Za-z0-9]')))::BIGINT AS w, len(string_split(sent_str, '.'))::BIGINT AS s FROM sents),
    e AS (SELECT docid, count(*) AS n, count(*) FILTER (w = 0) AS empty, sum(w)::BIGINT AS w, sum(CASE WHEN w > 0 THEN s ELSE 0 END)::BIGINT AS s FROM t GROUP BY 1),
    o AS (SELECT count(*) FILTER (n > empty) AS articles, sum(n - 1)::BIGINT AS extra_parts, count(*) FILTER (n > 1) AS long_articles, sum(empty)::BIGINT AS empty, sum(s)::BIGINT AS sentences, sum(w)::BIGINT AS words FROM e)
    SELECT *, round(sentences / articles, 6) AS mean_sentences, round(words / articles, 6) AS mean_words FROM o""")
def part_figures(s, d):
    return C.part_figures(table(s, d, "sents"), "docid", "sentence_id", "sent_str")


@query(r"""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[ \t\n\r.]+'), lambda w: w <> '') AS w FROM documents),
    g AS (SELECT unnest(w) AS gram, 1 AS size FROM t UNION ALL SELECT unnest([w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))]), 2 FROM t UNION ALL SELECT unnest([w[i] || '_' || w[i + 1] || '_' || w[i + 2] FOR i IN range(1, len(w) - 1)]), 3 FROM t
    UNION ALL SELECT unnest([w[i] || '_' || w[i + 1] || '_' || w[i + 2] || '_' || w[i + 3] FOR i IN range(1, len(w) - 2)]), 4 FROM t) SELECT gram, size, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 50""")
def gram_counts(s, d):
    return C.gram_counts(table(s, d, "documents"), "text", 50)


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\r.]+')) AS word FROM documents) WHERE word <> '' AND word NOT IN ('the', 'a', 'of', 'and', 'to', 'in') GROUP BY 1 HAVING count(*) >= 10""")
def word_counts_stopped(s, d):
    return C.word_counts(table(s, d, "documents"), "text", 10, ["the", "a", "of", "and", "to", "in"])


@query(f"SELECT row_number() OVER (ORDER BY year, month, day, section, doc_id) AS place, doc_id, section FROM (SELECT doc_id, min(year) AS year, min(month) AS month, min(day) AS day, coalesce(min(section), '') AS section FROM doc GROUP BY 1)")
def date_order(s, d):
    """The place of every article in the order of its date, section and id."""
    one = table(s, d, "doc").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("year", "month", "day")], F.coalesce(F.min("section"), F.lit("")).alias("section"))
    keyed = one.withColumn("_k", F.struct("year", "month", "day", "section", "doc_id"))
    return C.renumber(keyed, "_k", "place").select(F.col("place").cast("long").alias("place"), "doc_id", "section")


@query(f"SELECT row_number() OVER (ORDER BY make_date(year, month, day), dayname(make_date(year, month, day)), section, doc_id) AS place, doc_id FROM (SELECT doc_id, min(year) AS year, min(month) AS month, min(day) AS day, coalesce(min(section), '') AS section FROM doc GROUP BY 1)")
def weekday_order(s, d):
    one = table(s, d, "doc").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("year", "month", "day")], F.coalesce(F.min("section"), F.lit("")).alias("section"))
    day = F.make_date("year", "month", "day")
    keyed = one.withColumn("_k", F.struct(day.alias("d"), F.date_format(day, "EEEE").alias("w"), "section", "doc_id"))
    return C.renumber(keyed, "_k", "place").select(F.col("place").cast("long").alias("place"), "doc_id")


@query("SELECT lang, coalesce(sum(n) FILTER (source = 'Harbor Ledger'), 1)::BIGINT AS harbor, coalesce(sum(n) FILTER (source = 'Capstone Wire'), 1)::BIGINT AS capstone FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def source_pivot(s, d):
    """Documents by language and source, crosswise; 1 where there are none."""
    t = table(s, d, "documents").withColumn("k", F.when(F.col("source") == "Harbor Ledger", "harbor").when(F.col("source") == "Capstone Wire", "capstone"))
    return t.groupBy("lang").pivot("k", ["harbor", "capstone"]).agg(F.count(F.lit(1))).fillna(1, ["harbor", "capstone"])


@query("SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS most FROM documents")
def describe_lengths(s, d):
    c = F.col("n_chars")
    return table(s, d, "documents").agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("least"),
        *[F.percentile(c, F.lit(q)).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(c).alias("most"),
    )


@query("SELECT position::INTEGER AS position, name FROM (SELECT ordinal_position - 1 AS position, column_name AS name FROM information_schema.columns WHERE table_name = 'documents')")
def column_list(s, d):
    return C.describe_columns(table(s, d, "documents"))


@query(r"""SELECT doc_number, coalesce(len(list_filter(regexp_split_to_array(coalesce(title, ''), '[ \t\n\r]+'), lambda w: w <> '')), 0)::INTEGER + len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> ''))::INTEGER AS length, count(*) AS n FROM df GROUP BY ALL""")
def lengths_with_titles(s, d):
    t = table(s, d, "df").withColumn("length", C.word_count("title", "text"))
    return C.keep(t, ["doc_number", "length"]).groupBy("doc_number", "length").agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT term_str, min(term_id) AS term_id FROM vocab WHERE term_str IS NOT NULL AND term_id % 2 = 0 GROUP BY 1) SELECT DISTINCT t.term_str, coalesce(v.term_id, -1)::INTEGER AS term_id FROM (SELECT term_str FROM token WHERE term_str IS NOT NULL) t LEFT JOIN v USING (term_str)")
def lookup_ids(s, d):
    """Ids of the terms by a table that lacks half of them: -1 for those."""
    half = table(s, d, "vocab").where("term_str is not null and term_id % 2 = 0")
    words = table(s, d, "token").where("term_str is not null").select("term_str").distinct()
    return V.lookup(words, "term_str", half.select("term_str", "term_id"), "term_id")


@query("SELECT DISTINCT term_id, term_str FROM vocab WHERE term_str IN ('bank', 'judge') OR term_id IN (5, 17)")
def term_lookup(s, d):
    v = table(s, d, "vocab").select("term_id", "term_str").distinct()
    return v.where(F.col("term_str").isin("bank", "judge") | F.col("term_id").isin(5, 17))


@query("SELECT term_str FROM (SELECT DISTINCT term_str FROM vocab WHERE term_str IS NOT NULL) ORDER BY md5(term_str || '7'), term_str LIMIT 50")
def term_sample(s, d):
    """A seeded sample of fifty terms."""
    return table(s, d, "vocab").where("term_str is not null").select("term_str").distinct().orderBy(F.md5(F.concat("term_str", F.lit("7"))), "term_str").limit(50)


@query("SELECT source, count(*) AS n FROM df WHERE doc_number NOT IN (SELECT doc_number FROM labels) GROUP BY 1")
def uncoded_rows(s, d):
    """Articles nobody has rated, by source."""
    return C.by_ids(table(s, d, "df"), table(s, d, "labels"), "doc_number", include=False).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sentence_num, token_num, row_number() OVER (ORDER BY doc_id, sentence_num, token_num) - 1 AS place FROM (SELECT DISTINCT doc_id, sentence_num, token_num FROM token WHERE doc_id IS NOT NULL)")
def token_places(s, d):
    """The place of every token in the whole collection, in the order of articles."""
    t = table(s, d, "token").where("doc_id is not null").select("doc_id", "sentence_num", "token_num").distinct().withColumn("_k", F.struct("doc_id", "sentence_num", "token_num"))
    return C.renumber(t, "_k", "place").select("doc_id", "sentence_num", "token_num", (F.col("place") - 1).cast("long").alias("place"))
