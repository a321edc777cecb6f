"""Preparation of texts: accents, markup, stop words, substitutions, splitting and merging."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioflow.functions import cleaning as K

# Letters without a decomposition, and what they are in ASCII.
UNDIVIDED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Every letter that is a base letter with marks, and the base letter, by Unicode's decompositions."""
    pairs = []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if unicodedata.category(c)[0] == "L" and not 0xAC00 <= code <= 0xD7A3 and not 0xF900 <= code <= 0xFAFF:
            base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0] != c:
                pairs.append((c, base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def strip_accents(text: Column) -> Column:
    """Letters without their marks, composed or separate."""
    return F.regexp_replace(F.translate(text, *_accented()), r"\p{M}", "")


def ascii_fold(text: Column) -> Column:
    """Text in ASCII: letters without marks, undivided letters written out, all else beyond ASCII left out."""
    whole = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), UNDIVIDED.items(), text)
    return F.regexp_replace(strip_accents(whole), r"[^\x00-\x7F]", "")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "head", "title")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "title") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible(html: str | None) -> str | None:
    """What of a page is seen: no tags, scripts, styles or heads; entities are characters; a lone < is text."""
    if html is None or ("<" not in html and "&" not in html):
        return html
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def strip_html(pages: pd.Series) -> pd.Series:
    return pages.map(visible, na_action="ignore")


# Words to strip, as published lists have them.
PREPOSITIONS = "at by for from in into of on to with"
DIRECTIONS = "above below before after over under onto until since between"
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don re should now"
)


def strip_words(text: Column, words: str, blank: bool = True) -> Column:
    """The text without the words, each with the blank behind it (or without)."""
    pattern = "|".join(words.split())
    return F.regexp_replace(text, K._EDGE + f"({pattern})" + (" " if blank else K._EDGE), "")


def strip_stop_words(text: Column, possessives: bool = False, directions: bool = False, all_stop: bool = False) -> Column:
    """Articles and conjunctions, then prepositions; then possessives, directions and the long list where wanted."""
    out = strip_words(K.clean(text, [(r"\b(a|an|the|and|or|that) ", "")]), PREPOSITIONS)
    if possessives:
        out = strip_words(out, "my your his her its our their")
    if directions:
        out = strip_words(out, DIRECTIONS)
    return strip_words(out, STOP_WORDS, blank=False) if all_stop else out


def join_negations(text: Column) -> Column:
    """plusx and minusx left out, hyphens as underscores, "not" tied to the small word behind it."""
    bare = F.regexp_replace(text, K._EDGE + "(plusx|minusx)" + K._EDGE, "")
    return F.regexp_replace(F.replace(bare, F.lit("-"), F.lit("_")), K._EDGE + "not ([a-z]+)" + K._EDGE, F.lit("not_$1"))


def substitute(df: DataFrame, key: list[str], text: str, table: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Whole words replaced by a table (lower case; a capital stays one), by a join on the distinct words: any size of table."""
    marked = df.withColumn("_parts", F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0)))
    words = marked.select(F.explode(F.array_distinct(F.transform(F.filter("_parts", lambda w: w.rlike("^[A-Za-z]")), F.lower))).alias(source)).distinct()
    hits = words.join(table.select(source, target).dropDuplicates([source]), source)
    one = marked.select(*key, F.posexplode("_parts").alias("_at", "_w"))
    swapped = one.join(hits.withColumnRenamed(source, "_s"), F.lower("_w") == F.col("_s"), "left")
    new = F.when(F.col(target).isNull(), F.col("_w")).when(F.substring("_w", 1, 1) == F.upper(F.substring("_w", 1, 1)), F.initcap(target)).otherwise(F.col(target))
    whole = swapped.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", new.alias("w")))), lambda x: x["w"]), "").alias("_new"))
    return df.join(whole, key, "left").withColumn(text, F.coalesce("_new", text)).drop("_new")


def prepare(text: Column, negations: K.Rules, words: K.Rules, **stop: bool) -> Column:
    """Lower case, then negations, then substitutions (both rule tables), then stop words."""
    return strip_stop_words(K.clean(K.clean(F.lower(text), negations), words), **stop)


def strip_literal(text: Column, literal: str) -> Column:
    """The text without a string, in any case."""
    return F.regexp_replace(text, "(?i)" + re.sub(r"([^0-9A-Za-z ])", r"\\\1", literal), "")


def length_cell(cell: Column) -> Column:
    """The first word of a cell such as "312 words" as a number, 0 where it is none."""
    first = F.regexp_extract(F.coalesce(cell, F.lit("")), r"\S+", 0)
    return F.coalesce(first.try_cast("int"), F.lit(0))


def without_last_words(text: Column, n: int = 2) -> Column:
    """The text without its last ``n`` words."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, F.greatest(F.size(w) - n, F.lit(0))), " ")


def last_word(text: Column) -> Column:
    return F.element_at(F.filter(F.split(text, r"\s+"), lambda x: x != ""), -1)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line: the stretches between points, without blanks around; empty ones are none."""
    parts = df.select(key, F.posexplode(F.split(text, r"\.", -1)).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return parts.where("line <> ''")


_SENTENCE_END = r"(?<=[.!?])\s+(?=[\"'“(]?\p{Lu})"


def sentence_points(text: Column) -> Column:
    """Sentences, by end marks before a blank and a capital, without their end marks and joined by " . "."""
    parts = F.transform(F.split(text, _SENTENCE_END), lambda s: F.regexp_replace(F.trim(s), r"[.!?]+$", ""))
    return F.array_join(F.filter(parts, lambda s: s != ""), " . ")


def split_text(text: str, n: int) -> list[str]:
    """``n`` parts (up to 100) or parts of about ``n`` characters, each cut at the next blank; joined by one blank they are the text."""
    text = text.strip()
    if not text:
        return []
    parts = n if n <= 100 else 1 + len(text) // n
    size, out = max(1, int(len(text) / parts)), []
    for k in range(parts):
        end = len(text) if k == parts - 1 else text.find(" ", min(size, len(text) - 1))
        if end < 0 or end >= len(text):
            out.append(text)
            break
        out.append(text[:end])
        text = text[end + 1 :]
    return out


def split_texts(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key * 100 + part, and the part's text (part from 0; keys of more than 100 parts go on counting)."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, n), na_action="ignore")

    rows = df.select(F.col(key).alias("_k"), F.posexplode(parts(F.col(text))).alias("_p", text))
    return rows.select((F.col("_k") * 100 + F.col("_p")).alias(key), text)


def merge_to_length(df: DataFrame, group: str, order: str, text: str, length: int) -> DataFrame:
    """group, merge_no, ids, text: texts in order joined until they are longer than ``length``; a rest that is not is left out.

    A fold over each group, in pieces as they come: only the text being grown is held.
    """
    kinds = dict(df.dtypes)
    ordered = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")).repartition("g").sortWithinPartitions("g", "o")

    def fold(batches):  # noqa: ANN001, ANN202
        now, ids, grown, no = object(), [], "", 0
        for pdf in batches:
            rows = []
            for g, o, t in zip(pdf["g"], pdf["o"], pdf["t"]):
                if g != now:
                    now, ids, grown, no = g, [], "", 0
                ids.append(o)
                grown += t + " "
                if len(grown) > length:
                    rows.append((g, no, ids, grown))
                    ids, grown, no = [], "", no + 1
            yield pd.DataFrame(rows, columns=[group, "merge_no", "ids", text])

    return ordered.mapInPandas(fold, f"{group} {kinds[group]}, merge_no int, ids array<{kinds[order]}>, {text} string")


def dated_lines(lines: DataFrame, order: str, line: str, date: str, first: int, last: int, behind: int = 3) -> DataFrame:
    """Lines with a date line (and an empty one before it) put in before the line ``behind`` lines after "k of n DOCUMENTS",
    where k is from ``first`` to ``last``; new lines have the order of the line they stand before and rank below it."""
    w = Window.partitionBy("path").orderBy(order)
    k = F.regexp_extract(line, r"^\s*([0-9]+)\s+of\s+\S+\s+DOCUMENTS\s*$", 1).try_cast("int")
    hit = F.coalesce(F.lag(k.between(first, last), behind).over(w), F.lit(False))
    reset = F.max(k.between(first, last)).over(w.rowsBetween(-behind + 1, 0)) if behind > 1 else F.lit(False)
    marked = lines.withColumn("_hit", hit & ~F.coalesce(reset, F.lit(False)))
    new = F.when(F.col("_hit"), F.array(F.lit(""), F.lit(date), F.col(line))).otherwise(F.array(F.col(line)))
    return marked.select("path", order, F.posexplode(new).alias("rank", line))


def split_author(line: str | None) -> tuple[str, str] | None:
    """(author, text) of a line that begins with names in capitals; names may touch the text or an "and"."""
    if line is None:
        return None
    words, author = line.split(), []
    for i, w in enumerate(words):
        glued = re.match(r"([A-Z]{2,})([A-Z][a-z].*)$", w)
        if w in ("and", ","):
            author.append("and")
        elif w.startswith("and") and len(w) > 3 and w[3:].isupper():
            author += ["and", w[3:]]
        elif w.isupper() or not any(c.isalpha() for c in w):
            author.append(w)
        elif glued:
            return " ".join([*author, glued.group(1)]), " ".join([glued.group(2), *words[i + 1 :]])
        else:
            return " ".join(author), " ".join(words[i:])
    return " ".join(author), ""


def stem_texts(stem, together: bool = False):  # noqa: ANN001, ANN201
    """A function of a text column: every word stemmed, sentences (between points) joined by " . "; ``together``: negations tied, too.

    The stemmers remember words, so that each distinct word of a worker is stemmed once.
    """

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " . ".join(" ".join(stem(w) for w in part.split()) for part in t.split(".")), na_action="ignore")

    return lambda text: join_negations(apply(text)) if together else apply(text)
