"""Sections, pages and columns read from page marks such as "Section A; Page 12; Column 3", "A12", "Sports; Pg. 4" or "xiv"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What the letters of Roman numbers are worth.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _number(mark: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(mark, pattern, 1), F.lit("")).try_cast("int")


def section_letter(mark: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(mark, r"(?i)\bsection ([a-z])\b", 1), F.lit("")), F.nullif(F.regexp_extract(mark, r"^([A-Za-z])[0-9]+$", 1), F.lit("")))
    return F.upper(found)


def page(mark: Column) -> Column:
    """The page, -101 where there is none."""
    return F.coalesce(_number(mark, r"(?i)\b(?:page|pg\.?|p\.) ?([0-9]+)"), _number(mark, r"^[A-Za-z]([0-9]+)$"), _number(mark, r"^([0-9]+)$"), roman(mark), F.lit(-101))


def page_column(mark: Column) -> Column:
    return _number(mark, r"(?i)\bcolumn ([0-9]+)")


def roman(mark: Column) -> Column:
    """The value of a Roman number (smaller before greater is taken off), null for other texts."""
    low = F.lower(F.trim(mark))
    worth = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: worth[c])
    later = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(low.rlike("^[ivxlcdm]+$"), F.aggregate(later, F.lit(0), lambda a, v: a + v))


def _all(mark: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(mark), F.lit(pattern), F.lit(1))


# Indicators of each field of a page mark and what stands behind them.
_FIELDS = {"section": r"\bsection ([a-z0-9]+)", "part": r"\bpart ([a-z0-9]+)", "page": r"\b(?:page|pg\.?) ([a-z0-9]+)", "page_column": r"\b(?:column|col\.?) ([a-z0-9]+)"}


def letters_and_number(token: Column) -> tuple[Column, Column]:
    """(number of the first letter, 1 for a; number) of a token such as "b12"; 0 where there is none."""
    letter = F.regexp_extract(F.lower(token), r"^[^a-z]*([a-z])", 1)
    return F.when(letter == "", 0).otherwise(F.ascii(letter) - 96), F.coalesce(F.regexp_extract(token, r"([0-9]+)", 1).try_cast("int"), F.lit(0))


def strip_punctuation(token: Column) -> Column:
    """A token without marks at both ends."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def split_inside(token: Column) -> Column:
    """A token with marks inside as blanks."""
    return F.trim(F.regexp_replace(token, r"[^\p{L}\p{N}]+", " "))


def is_page_token(token: Column) -> Column:
    """At most two letters around at most three digits, at least one digit."""
    return F.coalesce(F.lower(token).rlike("^[a-z]{0,2}[0-9]{1,3}[a-z]{0,2}$"), F.lit(False))


def fields(mark: Column) -> Column:
    """section, part, page and page_column as numbers (letters count from a = 1; 0: none), read from their indicators or from a last
    token such as "b12"; repeated (an indicator stands twice with different values), ignored (letters and a number where the
    section is given, too) and none (nothing found)."""
    found = {name: _all(mark, pattern) for name, pattern in _FIELDS.items()}
    first = {name: F.coalesce(F.get(v, F.lit(0)), F.lit("")) for name, v in found.items()}
    last = F.element_at(F.split(split_inside(F.coalesce(mark, F.lit(""))), " "), -1)
    explicit = F.greatest(*[F.size(v) for v in found.values()]) > 0
    value = {name: (lambda letter, number: F.when(number > 0, number).otherwise(letter))(*letters_and_number(v)) for name, v in first.items()}
    page_letter, _ = letters_and_number(first["page"])
    page_has_both = (page_letter > 0) & (letters_and_number(first["page"])[1] > 0)
    token_letter, token_number = letters_and_number(last)
    implicit = ~explicit & is_page_token(last)
    section = F.when(explicit, F.when(value["section"] > 0, value["section"]).when(page_has_both, page_letter).otherwise(0)).when(implicit, token_letter).otherwise(0)
    page_no = F.when(explicit, value["page"]).when(implicit, token_number).otherwise(0)
    repeated = F.greatest(*[F.size(F.array_distinct(v)) for v in found.values()]) > 1
    return F.struct(
        section.cast("int").alias("section"), F.when(explicit, value["part"]).otherwise(0).cast("int").alias("part"), page_no.cast("int").alias("page"),
        F.when(explicit, value["page_column"]).otherwise(0).cast("int").alias("page_column"), repeated.alias("repeated"),
        F.coalesce(explicit & page_has_both & (value["section"] > 0), F.lit(False)).alias("ignored"), (~explicit & ~implicit).alias("none"),
    )
