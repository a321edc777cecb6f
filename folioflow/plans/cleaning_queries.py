"""Queries of the cleaning chains; their SQL is rendered from the same rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import cleaning as K
from folioflow.plans.lineage import spread
from folioflow.plans.vector_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _rules(name: str, rules: K.Rules, lang: str | None) -> None:
    def run(s, d):  # noqa: ANN001, ANN202
        docs = table(s, d, "documents")
        docs = docs.where(F.col("lang") == lang) if lang else docs
        return spread(docs.select("doc_id", "text")).select("doc_id", K.clean(F.col("text"), rules).alias("clean"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {K.clean_sql('text', rules)} AS clean FROM documents" + (f" WHERE lang = '{lang}'" if lang else "")


for _name, _language, _lang in (("clean_english", "english", "en"), ("clean_french", "français", "fr"), ("clean_german", "deutsch", "de"), ("clean_spanish", "espanol", "es"), ("clean_dutch", "nederlands", "en"), ("clean_danish", "dansk", "en"), ("clean_italian", "italiano", "fr")):
    _rules(_name, K.chain(_language), _lang)
_rules("clean_english_no_commas", K.ENGLISH_NO_COMMAS, "en")
for _name, _table in (("stop_basic", K.STOP_BASIC), ("stop_possessives", K.STOP_POSSESSIVE), ("concat_not", K.NOT_TOGETHER), ("strip_commas", K.STRIP_COMMAS), ("strip_points", K.STRIP_POINTS), ("unwrap_asterisks", K.UNWRAP_STARS)):
    _rules(_name, _table, None)


def _plain(name: str, column, sql: str) -> None:  # noqa: ANN001
    def run(s, d):  # noqa: ANN001, ANN202
        return table(s, d, "documents").select("doc_id", column().alias("value"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {sql} AS value FROM documents"


_plain("lower_text", lambda: F.lower("text"), "lower(text)")
_plain("prefix_article", lambda: F.concat(F.lit("news "), F.col("text")), "'news ' || text")
_plain("prefix_sentence", lambda: F.array_join(F.transform(F.split("text", r" \. "), lambda x: F.concat(F.lit("s "), x)), " . "), "array_to_string([('s ' || x) for x in string_split(text, ' . ')], ' . ')")
_plain("join_text_columns", lambda: F.concat_ws(" . ", "source", "section", "text"), "concat_ws(' . ', source, section, text)")
_plain("split_points", lambda: F.size(F.split("text", r"\.", -1)), "len(string_split(text, '.'))::INTEGER")
_plain("last_word", lambda: F.element_at(F.split("text", " "), -1), "string_split(text, ' ')[-1]")
_plain("ascii_fold", lambda: F.translate(F.replace("text", F.lit("ß"), F.lit("ss")), "àáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "aaaaceeeeiiiinoooouuuuAAAACEEEEIIIINOOOOUUUU"), "translate(replace(text, 'ß', 'ss'), 'àáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ', 'aaaaceeeeiiiinoooouuuuAAAACEEEEIIIINOOOOUUUU')")
