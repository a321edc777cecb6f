"""Articles from vendors' dumps: every file is one row in, every article one row out.

The line grammar of each vendor is read by a generator per file, in parallel over files; everything
behind it (dates, weekdays, forward fill, duplicates of a day) is done on the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.operators.dedup import delivered_again
from folioflow.operators.corpus import MONTHS, date_of, fill_forward, month_names, word_count

SCHEMA = "path string, seq int, vendor_id string, publication string, date_line string, title string, edition string, text string, meta map<string,string>"
# Sources that are left out, how long a part of a text may be, the notice of missing rights, and the sources of one country.
SKIPPED_SOURCES = ("blogs", ".co", "law")
PART_LENGTH = 32_600
NO_RIGHTS = "voor dit artikel geen publicatierecht"
US_SOURCES = (
    "wall street journal", "boston globe", "tampa bay times", "star-tribune", "new york times", "washington post", "usa today",
    "atlanta journal-constitution", "philadelphia inquirer", "denver post", "daily news", "new york post", "san jose mercury news",
)
_META = re.compile(r"^([A-Z][A-Za-z-]*(?: [A-Za-z-]+){0,2}): ?(.*)$")
_CAPS = re.compile(r"^([A-Z][A-Z-]+): ?(.*)$")

Article = tuple[str | None, str | None, str | None, str, str | None, str, dict[str, str]]


def split_text(text: str, size: int = PART_LENGTH) -> list[str]:
    """Parts of about ``size`` characters, cut behind the next blank, or at a blank in the last 100, or hard; joined they are the text."""
    parts, at = [], 0
    while len(text) - at > size:
        end = text.find(" ", at + size, at + size + 100)
        if end < 0:
            end = text.rfind(" ", at + size - 100, at + size)
        end = at + size if end < 0 else end + 1
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def skipped(source: Column, only: tuple[str, ...] | None = None) -> Column:
    """Whether a source is left out: its name holds one of SKIPPED_SOURCES, or it is not one of ``only``."""
    low = F.lower(source)
    out = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in SKIPPED_SOURCES])
    return F.coalesce(out | ~low.isin(*only) if only else out, F.lit(False))


def without_rights(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows but those whose text only says that there is no right to publish it."""
    return df.where(~F.coalesce(F.contains(text, F.lit(NO_RIGHTS)), F.lit(False)))


def is_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))


def is_year(value: Column) -> Column:
    """A whole number from 1800 to 2100."""
    return is_int(value) & F.coalesce(F.trim(value.cast("string")).try_cast("long").between(1800, 2100), F.lit(False))


def is_month(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*MONTHS), F.lit(False))


def is_word_count(line: Column) -> Column:
    """Two words, the second "words"."""
    return F.coalesce(line.rlike(r"^\s*\S+\s+words\s*$"), F.lit(False))


def is_date_line(line: Column) -> Column:
    """A line such as "May 3, 2001 Thursday 9:00 AM Eastern Time"."""
    month = "|".join(MONTHS)
    return F.coalesce(line.rlike(rf"(?i)^\s*({month})\s+[0-9]+\S(\s.*)?\s(?-i:Time)\s*$"), F.lit(False))


def numbered(parsed: DataFrame, name: str = "doc_nr") -> DataFrame:
    """Articles of all files under one running number from 1, by path and place in the file."""
    from folioflow.operators.corpus import renumber

    keyed = parsed.withColumn("_key", F.concat_ws("\x01", "path", F.lpad(F.col("seq").cast("string"), 10, "0")))
    return renumber(keyed, "_key", name).drop("_key")


def _blocks(lines: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            out[-1].append(line.strip())
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def lexis(dump: str) -> Iterator[Article]:
    """Articles that begin with "k of n DOCUMENTS" and end with a copyright line."""
    for piece in re.split(r"(?m)^\s*(?=\d+ of \d+ DOCUMENTS)", dump):
        blocks = _blocks(piece.splitlines())
        if not blocks or "DOCUMENTS" not in blocks[0][0]:
            continue
        number = re.match(r"(\d+) of", blocks[0][0])
        head = [line for b in blocks[1:3] for line in b]
        if len(head) < 2:
            continue
        meta, body, title = {}, [], ""
        for b in blocks[3:]:
            caps = _CAPS.match(b[0])
            if b[0].startswith(("Copyright", "©")):
                break
            if caps:
                meta[caps.group(1)] = " ".join([caps.group(2), *b[1:]]).strip()
            elif not title:
                title = " ".join(b)
            elif " ".join(b).upper() != " ".join(b):
                body.append(" ".join(b))
        yield number and number.group(1), head[0], head[1], title, None, " ".join(body), meta


def nexis_uni(dump: str) -> Iterator[Article]:
    """Articles parted by "End of Document"; title, source and date stand before the first blank line, the text behind "Body"."""
    for k, piece in enumerate(dump.split("End of Document")):
        blocks = _blocks(piece.splitlines())
        body_at = next((i for i, b in enumerate(blocks) if b[0] == "Body"), None)
        if body_at is None or not blocks:
            continue
        head = [line for b in blocks[:body_at] for line in b]
        meta = {m.group(1): m.group(2) for line in head if (m := _META.match(line))}
        plain = [line for line in head if not _META.match(line)]
        text = [" ".join(b) for b in blocks[body_at:]]
        text[0] = text[0][4:].strip()
        title, source, day = [*plain, "", "", ""][:3]
        abstract = [t for t in text if t.startswith("ABSTRACT")]
        yield str(k + 1), source or None, day or None, " ".join([title, *abstract]).strip(), None, " ".join(t for t in text if t and not t.startswith("ABSTRACT")), meta


def factiva(dump: str) -> Iterator[Article]:
    """Articles that end with "Document" and an id of 25 characters; the line of the word count parts title and particulars."""
    for piece, ident in _factiva_pieces(dump):
        lines = [line.strip() for line in piece.splitlines() if line.strip()]
        count = next((i for i, line in enumerate(lines) if re.match(r"^[\d,]+ words$", line)), None)
        if count is None or not any(line.startswith(("(c)", "Copyright", "©")) for line in lines):
            continue
        end = next(i for i, line in enumerate(lines) if i > count and line.startswith(("(c)", "Copyright", "©")))
        head, rest = lines[:count], lines[count + 1 : end]
        author = next((line[3:] for line in head if line.startswith("By ")), "")
        title = next((line for line in head if not line.startswith("By ")), "")
        section = ""
        for mark in (" --- ", " -- ", ": "):
            if mark in title and len(title.split(mark)[0].split()) <= 3:
                section, title = title.split(mark, 1)
                break
        meta = {"AUTHOR": author, "SECTION": section, "LENGTH": lines[count].split()[0]}
        yield ident, rest[1] if len(rest) > 1 else None, rest[0] if rest else None, title, None, " ".join(lines[end + 1 :]), {k: v for k, v in meta.items() if v}


def _factiva_pieces(dump: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in re.finditer(r"(?m)^Document (\S{25})\s*$", dump):
        out.append((dump[at : m.start()], m.group(1)))
        at = m.end()
    return out


def proquest(dump: str) -> Iterator[Article]:
    """Articles parted by lines of 60 underscores, blocks of "key: value", the first of a key counts."""
    for piece in re.split("_{60,}", dump)[:-1]:
        pairs: dict[str, str] = {}
        for block in _blocks(piece.splitlines()):
            m = _META.match(" ".join(block))
            if m:
                pairs.setdefault(m.group(1), m.group(2).strip())
        if not pairs:
            continue
        link = re.search(r"https?:\S*/(\d+)", piece)
        title = pairs.get("Title", "")
        edition = re.search(r"\[(.*?)\]", title)
        yield link and link.group(1), pairs.get("Publication title"), pairs.get("Publication date"), title, edition and edition.group(1), pairs.get("Full text", ""), pairs


READERS: dict[str, Callable[[str], Iterator[Article]]] = {"LN": lexis, "NexisUni": nexis_uni, "Factiva": factiva, "ProQuest": proquest}


def read_dumps(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path and value (the whole text) of every file under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("path"), "value")


def parse(dumps: DataFrame, vendor: str | None = None) -> DataFrame:
    """Articles of the dumps (path, value); the vendor is given or is the name of a folder in the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, value in zip(pdf["path"], pdf["value"]):
                name = vendor or next((v for v in READERS if f"/{v}/" in path), None)
                if name and value:
                    rows += [(path, i, *a) for i, a in enumerate(READERS[name](value))]
            yield pd.DataFrame(rows, columns=["path", "seq", "vendor_id", "publication", "date_line", "title", "edition", "text", "meta"])

    return dumps.select("path", "value").mapInPandas(run, SCHEMA)


def articles(parsed: DataFrame, fill: bool = False) -> DataFrame:
    """Parsed articles with year, month, day, weekday, length, and duplicate: whether its file has the article of its day before.

    ``fill``: missing dates, sources and languages are those of the article before (as in ProQuest dumps).  Sources on the
    list of skipped ones and notices without rights are left out.
    """
    out = fill_forward(parsed, ["path"], ["seq"], ["publication", "date_line"]) if fill else parsed
    month = r"(?iu)(?<!\pL)(" + "|".join(sorted(month_names(every=True), key=len, reverse=True)) + r")(?!\pL)"
    line = F.col("date_line")
    name = F.regexp_extract(line, month, 1)
    day = F.coalesce(F.nullif(F.regexp_extract(line, month + r"\.? (\d{1,2})\b", 2), F.lit("")), F.regexp_extract(line, r"\b(\d{1,2})(?:\.|er|º)?(?: de)? " + month, 1))
    year = F.regexp_extract(line, r"\b((?:18|19|20)\d\d)\b", 1)
    out = out.withColumn("published", date_of(year, name, day, every=True)).withColumn("weekday", F.date_format("published", "EEEE")).withColumn("length", word_count("title", "text"))
    return delivered_again(without_rights(out.where(~skipped(F.col("publication")))), "path", "published", "seq", "title", "text")
