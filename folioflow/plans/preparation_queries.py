"""Queries that prepare texts: accents, markup, stop words, substitutions, pages, splitting and merging."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from folioflow.functions import cleaning as K, pages, porter, porter2, text as X
from folioflow.functions.strings import column
from folioflow.plans.lineage import spread
from folioflow.plans.registry import registry, table
from folioflow.sources import vendors

QUERIES, ORACLES, query = registry()


def docs(s, d):  # noqa: ANN001, ANN201
    """The documents, spread over the cores: preparing texts outweighs moving them."""
    return spread(table(s, d, "documents"))


def _words(words: str) -> str:
    return r"\b(" + "|".join(words.split()) + r")"


@query("SELECT doc_id, strip_accents(text) AS value FROM documents")
def accents_stripped(s, d):
    """Letters of all scripts without their marks."""
    return docs(s, d).select("doc_id", X.strip_accents(F.col("text")).alias("value"))


_FOLD = "regexp_replace(strip_accents(" + "".join("replace(" for _ in X.UNDIVIDED) + "text" + "".join(f", '{a}', '{b}')" for a, b in X.UNDIVIDED.items()) + r"), '[^\x00-\x7F]', '', 'g')"


@query(f"SELECT doc_id, {_FOLD} AS value FROM documents")
def ascii_only(s, d):
    return docs(s, d).select("doc_id", X.ascii_fold(F.col("text")).alias("value"))


@query("SELECT doc_id, text AS value FROM documents")
def html_visible(s, d):
    """Texts put into a page with entities, a head, a script and tags, and what is then seen of it: the texts again."""
    low = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>none</title><style>p {}</style></head><body><p class='x'>"), low, F.lit("</p><script>if (a < b) run()</script></body></html>"))
    return docs(s, d).select("doc_id", X.strip_html(page).alias("value"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\b(a|an|the|and|or|that) ', '', 'g'), '{_words(X.PREPOSITIONS)} ', '', 'g') AS value FROM documents")
def stop_words_usual(s, d):
    return docs(s, d).select("doc_id", X.strip_stop_words(F.lower("text")).alias("value"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(a|an|the|and|or|that) ', '', 'g'), '{_words(X.PREPOSITIONS)} ', '', 'g'),
    '\b(my|your|his|her|its|our|their) ', '', 'g'), '{_words(X.DIRECTIONS)} ', '', 'g'), '{_words(X.STOP_WORDS)}\b', '', 'g') AS value FROM documents""")
def stop_words_all(s, d):
    return docs(s, d).select("doc_id", X.strip_stop_words(F.lower("text"), possessives=True, directions=True, all_stop=True).alias("value"))


@query(r"SELECT doc_id, regexp_replace(replace(regexp_replace(lower(text), '\b(plusx|minusx)\b', '', 'g'), '-', '_'), '\bnot ([a-z]+)\b', 'not_\1', 'g') AS value FROM documents")
def negations_joined(s, d):
    return docs(s, d).select("doc_id", X.join_negations(F.lower("text")).alias("value"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\bdid not\b', 'not', 'g'), '\bnever\b', 'not', 'g'), '\b(a|an|the|and|or|that) ', '', 'g'), '\b(at|by|for|from|in|into|of|on|to|with) ', '', 'g') AS value FROM documents""")
def prepared_text(s, d):
    """Lower case, negations, substitutions and stop words, one after another."""
    return docs(s, d).select("doc_id", X.prepare(F.col("text"), [(r"\bdid not\b", "not")], [(r"\bnever\b", "not")]).alias("value"))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda w: CASE lower(w) WHEN 'bank' THEN CASE WHEN w[1] = upper(w[1]) THEN 'Institute' ELSE 'institute' END
    WHEN 'judge' THEN CASE WHEN w[1] = upper(w[1]) THEN 'Magistrate' ELSE 'magistrate' END ELSE w END), '') AS text FROM documents""")
def words_substituted(s, d):
    """Whole words replaced by a table of any size."""
    words = s.createDataFrame([("bank", "institute"), ("judge", "magistrate")], "source string, target string")
    return X.substitute(docs(s, d).select("doc_id", "text"), ["doc_id"], "text", words)


@query("SELECT doc_id, regexp_replace(text, '(?i)corp\\.', '', 'g') AS value FROM documents")
def literal_stripped(s, d):
    return docs(s, d).select("doc_id", X.strip_literal(F.col("text"), "corp.").alias("value"))


@query(r"SELECT doc_number, coalesce(try_cast(nullif(regexp_extract(coalesce(num_day, ''), '\S+'), '') AS INTEGER), 0) AS value, count(*) AS n FROM df WHERE NOT contains(coalesce(num_day, ''), '.') GROUP BY 1, 2 UNION ALL SELECT doc_number, 0, count(*) FROM df WHERE contains(coalesce(num_day, ''), '.') GROUP BY 1")
def first_number_of_cell(s, d):
    return table(s, d, "df").groupBy("doc_number", X.length_cell(F.col("num_day")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


_SPLIT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, array_to_string({_SPLIT}[1:greatest(len({_SPLIT}) - 2, 0)], ' ') AS value, {_SPLIT}[-1] AS last FROM documents WHERE text IS NOT NULL")
def last_words_cut(s, d):
    return docs(s, d).where("text is not null").select("doc_id", X.without_last_words(F.col("text")).alias("value"), X.last_word(F.col("text")).alias("last"))


@query("WITH t AS (SELECT doc_id, string_split(text, '.') AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS line_no, regexp_replace(unnest(p), '^ +| +$', '', 'g') AS line FROM t) SELECT * FROM u WHERE line <> ''")
def lines_of_texts(s, d):
    return X.lines_of(docs(s, d).select("doc_id", "text"), "doc_id", "text")


@query()
def sentences_joined(s, d):
    """Sentences joined by " . ", by a rule in the JVM."""
    return docs(s, d).select("doc_id", X.sentence_points(F.col("text")).alias("value"))


@query("SELECT doc_id, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def split_joined(s, d):
    """Texts cut into parts of about three hundred characters, and the parts joined again by one blank: the texts."""
    parts = X.split_texts(docs(s, d).select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")), "doc_id", "text", 300)
    rows = parts.select(F.floor(F.col("doc_id") / 100).alias("d"), F.col("doc_id").alias("p"), "text")
    whole = rows.groupBy("d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), " ").alias("text"))
    return whole.select(F.col("d").alias("doc_id"), "text")


@query()
def parts_of_texts(s, d):
    return X.split_texts(docs(s, d).select("doc_id", "text"), "doc_id", "text", 5)


@query()
def merged_to_length(s, d):
    """Texts of each source joined until they are longer than five thousand characters."""
    return X.merge_to_length(docs(s, d).where("source is not null"), "source", "doc_id", "text", 5000).select("source", "merge_no", F.size("ids").alias("n"), F.length("text").alias("length"))


@query()
def stems_of_texts(s, d):
    """Distinct words of texts with their stems: every word is stemmed once."""
    words = docs(s, d).select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 2))).alias("word")).distinct()
    return words.withColumn("stem", column(porter.stem, T.StringType())("word"))


@query(r"""SELECT year, regexp_full_match(coalesce(year, ''), '\s*[+-]?[0-9]+\s*') AS whole, coalesce(regexp_full_match(year, '\s*[+-]?[0-9]+\s*') AND try_cast(trim(year) AS BIGINT) BETWEEN 1800 AND 2100, false) AS valid, count(*) AS n FROM df GROUP BY 1, 2, 3""")
def year_checks(s, d):
    y = F.col("year")
    return table(s, d, "df").groupBy("year", vendors.is_int(y).alias("whole"), vendors.is_year(y).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT month, coalesce(lower(trim(month)) IN ('january','february','march','april','may','june','july','august','september','october','november','december'), false) AS valid, count(*) AS n FROM df GROUP BY 1, 2")
def month_checks(s, d):
    return table(s, d, "df").groupBy("month", vendors.is_month(F.col("month")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM df WHERE NOT coalesce(contains(text, 'voor dit artikel geen publicatierecht'), false) GROUP BY 1")
def notices_left_out(s, d):
    return vendors.without_rights(table(s, d, "df")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query()
def author_split(s, d):
    """Names in capitals at the head of a text, and the rest."""
    headed = docs(s, d).where("text is not null").select("doc_id", F.concat(F.upper(F.coalesce("source", F.lit(""))), F.lit(" "), F.regexp_extract("text", r"[^\n]*", 0)).alias("line"))
    parts = column(lambda line: list(X.split_author(line)), T.ArrayType(T.StringType()))
    return headed.select("doc_id", parts("line").alias("p")).select("doc_id", F.col("p")[0].alias("author"), F.length(F.col("p")[1]).alias("rest"))


@query(r"""WITH t AS (SELECT DISTINCT lower(trim(section)) AS m FROM df WHERE section IS NOT NULL), v AS (SELECT m, [CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END FOR c IN string_split(m, '')] AS w FROM t WHERE regexp_full_match(m, '[ivxlcdm]+'))
    SELECT m AS mark, list_sum([CASE WHEN w[i] < coalesce(w[i + 1], 0) THEN -w[i] ELSE w[i] END FOR i IN range(1, len(w) + 1)])::INTEGER AS value FROM v UNION ALL SELECT m, NULL FROM t WHERE NOT regexp_full_match(m, '[ivxlcdm]+')""")
def roman_marks(s, d):
    t = table(s, d, "df").where("section is not null").select(F.lower(F.trim("section")).alias("mark")).distinct()
    return t.withColumn("value", pages.roman(F.col("mark")))


@query(f"SELECT doc_number, year, month, {K.clean_sql(_FOLD.replace('text', 'body'), K.chain('english'))} AS text FROM (SELECT DISTINCT doc_number, year, month, concat_ws(' . ', title, text) AS body FROM df WHERE language = 'English')")
def cleaned_articles(s, d):
    """Title and text joined, in ASCII and cleaned, beside the columns that are kept."""
    one = table(s, d, "df").where("language = 'English'").select("doc_number", "year", "month", F.concat_ws(" . ", "title", "text").alias("body")).distinct()
    return spread(one).select("doc_number", "year", "month", K.clean(X.ascii_fold(F.col("body")), K.chain("english")).alias("text"))


@query(r"""WITH m AS (SELECT DISTINCT section FROM df WHERE section IS NOT NULL), t AS (SELECT section, list_filter(string_split(trim(regexp_replace(section, '[^\pL\pN]+', ' ', 'g')), ' '), lambda x: true)[-1] AS last FROM m)
    SELECT section, last, regexp_full_match(lower(last), '[a-z]{0,2}[0-9]{1,3}[a-z]{0,2}') AS is_page, coalesce(try_cast(nullif(regexp_extract(last, '([0-9]+)', 1), '') AS INTEGER), 0) AS number,
    CASE WHEN regexp_extract(lower(last), '^[^a-z]*([a-z])', 1) = '' THEN 0 ELSE ascii(regexp_extract(lower(last), '^[^a-z]*([a-z])', 1)) - 96 END::INTEGER AS letter FROM t""")
def page_tokens(s, d):
    """The last token of every section mark: whether it is one of a page, its number and letter."""
    t = table(s, d, "df").where("section is not null").select("section").distinct().withColumn("last", F.element_at(F.split(pages.split_inside(F.col("section")), " "), -1))
    letter, number = pages.letters_and_number(F.col("last"))
    return t.select("section", "last", pages.is_page_token(F.col("last")).alias("is_page"), number.alias("number"), letter.cast("int").alias("letter"))


@query()
def page_fields(s, d):
    """Section, part, page and column of every section mark, with what was odd about it."""
    return table(s, d, "df").where("section is not null").select("section").distinct().select("section", F.inline(F.array(pages.fields(F.col("section")))).alias("f_section", "part", "page", "page_column", "repeated", "ignored", "none"))


@query(f"SELECT term_str, (term_str IN ({', '.join(repr(w) for w in X.STOP_WORDS.split())}) OR term_str IN ('said', 'mr', 'corp'))::INTEGER AS stop FROM (SELECT DISTINCT term_str FROM vocab WHERE term_str IS NOT NULL)")
def stop_flags(s, d):
    """Stop flags of the vocabulary by the published list and words of one's own, by a join."""
    words = s.createDataFrame([(w,) for w in sorted({*X.STOP_WORDS.split(), "said", "mr", "corp"})], "term_str string").withColumn("stop", F.lit(1))
    return table(s, d, "vocab").where("term_str is not null").select("term_str").distinct().join(words, "term_str", "left").fillna(0, ["stop"])


@query("SELECT year, month, day, section, doc_key, row_number() OVER (ORDER BY year, month, day, coalesce(section, ''), coalesce(doc_key, ''), section IS NULL, doc_key IS NULL) - 1 AS new_id FROM (SELECT DISTINCT year, month, day, section, doc_key FROM doc WHERE doc_key IS NULL OR doc_key NOT IN ('pm', 'billion', 'million', 'am'))")
def doc_ids(s, d):
    """Distinct articles by date, section and key, with new ids."""
    from folioflow.operators.corpus import renumber

    t = table(s, d, "doc").where(F.col("doc_key").isNull() | ~F.col("doc_key").isin("pm", "billion", "million", "am")).select("year", "month", "day", "section", "doc_key").distinct()
    key = F.struct("year", "month", "day", F.coalesce("section", F.lit("")).alias("s"), F.coalesce("doc_key", F.lit("")).alias("k"), F.col("section").isNull().alias("sn"), F.col("doc_key").isNull().alias("kn"))
    return renumber(t.withColumn("_k", key), "_k", "new_id").withColumn("new_id", (F.col("new_id") - 1).cast("long")).drop("_k")


@query()
def snowball_stems(s, d):
    """Every distinct term of the vocabulary with its stem of the second form."""
    terms = table(s, d, "vocab").where("term_str is not null").select("term_str").distinct()
    return terms.withColumn("stem", column(porter2.stem, T.StringType())("term_str"))


@query()
def stemmed_texts(s, d):
    """Texts in lower case with their words stemmed and negations tied to what they deny."""
    return docs(s, d).select("doc_id", X.stem_texts(porter.stem, together=True)(F.lower("text")).alias("value"))
