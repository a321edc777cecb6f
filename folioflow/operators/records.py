"""Rows that fail to parse: an error-recovering recursive-descent reader of comma-separated records.

Grammar::

    file    := record (line_break record)*
    record  := field ("," field)*
    field   := quoted | bare
    quoted  := '"' (any but '"' | '""')* '"'      closed right before "," or the line's end
    bare    := (any but ',' '"' line_break)*

A broken quotation leaves no way to tell where its record ends.  The reader then resumes at the
next record-start anchor: a line break behind which a whole record of the wanted number of fields
parses.  Every record comes out with its fields or with the located first error; nothing is dropped.

A line as received (``whole``) ends where its text ends, and line breaks in it are text; but behind
a broken quotation it, too, is searched for anchors, so that records glued to a broken one are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The fields of a line, and the English months with their longest day.
FIELDS = ("docid", "year", "month", "num_day", "weekday", "title", "text", "section")
MONTH_DAYS = {
    "january": 31, "february": 29, "march": 31, "april": 30, "may": 31, "june": 30,
    "july": 31, "august": 31, "september": 30, "october": 31, "november": 30, "december": 31,
}
FIRST_YEAR, LAST_YEAR = 1999, 2002
BLANKS = r"[\s\x{00A0}\x{3000}\x{2000}-\x{200B}\x{202F}\x{FEFF}]*"


_LINE_BREAK = re.compile("\r\n|\n|\r")


@dataclass
class Record:
    """One record: its fields, or the first error with its place in the text."""

    start: int
    end: int = 0
    fields: list[str] = field(default_factory=list)
    error: str | None = None
    error_at: int | None = None


class RecordReader:
    """Recursive descent over one text; ``whole`` reads it as a line, whose record ends where the text ends."""

    def __init__(self, text: str, n_fields: int = len(FIELDS), whole: bool = False) -> None:
        self.text, self.at, self.n_fields, self.whole = text, 0, n_fields, whole
        self.end = len(text.rstrip("\r\n")) if whole else len(text)

    def records(self) -> Iterator[Record]:
        if self.whole:
            yield self.record()
        while self.at < self.end:
            yield self.record()

    def record(self) -> Record:
        out = Record(self.at)
        while True:
            value, wrong = self.field()
            out.fields.append(value)
            if wrong is not None:
                out.error, out.error_at = "quoting", wrong
                self.recover()
                break
            if self.at < self.end and self.text[self.at] == ",":
                self.at += 1
                continue
            break
        out.end = self.at
        self.line_break()
        return out

    def field(self) -> tuple[str, int | None]:
        return self.quoted() if self.text[self.at : self.at + 1] == '"' and self.at < self.end else self.bare()

    def quoted(self) -> tuple[str, int | None]:
        opened, at, parts = self.at, self.at + 1, []
        while True:
            close = self.text.find('"', at, self.end)
            if close < 0:
                return self.text[opened : self.end], opened
            parts.append(self.text[at:close])
            if self.text[close + 1 : close + 2] == '"' and close + 1 < self.end:
                parts.append('"')
                at = close + 2
                continue
            self.at = close + 1
            if self.at >= self.end or self.text[self.at] == "," or (not self.whole and self.text[self.at] in "\r\n"):
                return "".join(parts), None
            self.at = opened + 1  # records may begin within what was taken for text
            return "".join(parts), close

    def bare(self) -> tuple[str, int | None]:
        stop = re.compile('[,"]' if self.whole else '[,"\r\n]').search(self.text, self.at, self.end)
        start, self.at = self.at, stop.start() if stop else self.end
        if stop and stop.group() == '"':
            return self.text[start : self.at], self.at
        return self.text[start : self.at], None

    def recover(self) -> None:
        """To the line break before the next validated anchor, or to the end."""
        for m in _LINE_BREAK.finditer(self.text, self.at, self.end):
            if self.anchored(m.end()):
                self.at, self.whole = m.start(), False
                return
        self.at = self.end

    def anchored(self, at: int) -> bool:
        """Whether a record with all its fields starts at ``at``."""
        trial = RecordReader(self.text, self.n_fields)
        trial.at, trial.end = at, self.end
        for n in range(1, self.n_fields + 1):
            if trial.field()[1] is not None:
                return False
            if trial.at >= trial.end or trial.text[trial.at] != ",":
                return n == self.n_fields
            trial.at += 1
        return False

    def line_break(self) -> None:
        for mark in ("\r\n", "\n", "\r"):
            if self.text.startswith(mark, self.at):
                self.at += len(mark)
                return


def date_fault(year: Column, month: Column, day: Column) -> Column:
    """'year', 'month' or 'day', the first that is no valid part of a date; null if all are. Blanks around do not count."""
    y, m, d = (F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "") for c in (year, month, day))
    longest = F.coalesce(*[F.when(F.lower(m) == k, F.lit(v)) for k, v in MONTH_DAYS.items()])
    number = F.when(d.rlike("^[0-9]{1,2}$"), d.try_cast("int"))
    leap = (y.try_cast("int") % 4 == 0) & ((y.try_cast("int") % 100 != 0) | (y.try_cast("int") % 400 == 0))
    limit = F.when((F.lower(m) == "february") & ~leap, F.lit(28)).otherwise(longest)
    return (
        F.when(~F.coalesce(y.rlike("^[0-9]{4}$") & y.try_cast("int").between(FIRST_YEAR, LAST_YEAR), F.lit(False)), F.lit("year"))
        .when(longest.isNull(), F.lit("month"))
        .when(~F.coalesce((number >= 1) & (number <= limit), F.lit(False)), F.lit("day"))
    )


_PARSED = T.StructType([
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
    T.StructField("error_at", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def _parser(n_fields: int, whole: bool):  # noqa: ANN202
    @F.pandas_udf(T.ArrayType(_PARSED))
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append([(None, "column_count", 0, 0, 0)] if whole else [])
            else:
                out.append([(r.fields, r.error, r.error_at, r.start, r.end) for r in RecordReader(text, n_fields, whole).records()])
        return pd.Series(out, dtype=object)

    return parse


def parse_records(df: DataFrame, text: str, columns: tuple[str, ...] = FIELDS, whole: bool = True) -> DataFrame:
    """The rows of ``df``, one for each record of ``text``, with record_no (from 0), record (a struct
    of ``columns``), reason, reason_at and n_fields.

    ``whole``: each text is a line as received, one record and those found at anchors behind a broken quotation; otherwise a
    text is a file of many, parted by line breaks, with the same recovery.
    A record is null where a reason stands and the other way round.  Reasons, the first that applies: quoting,
    column_count, year, month, day.  A null text is one reject ('column_count') as a line, no record as a file; an empty
    line is a reject, too.  Columns of ``df`` named as the new ones are replaced.
    """
    new = ("record_no", "record", "reason", "reason_at", "n_fields")
    kept = [c for c in df.columns if c not in new]
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(_parser(len(columns), whole)(F.col(text))).alias("record_no", "_p"))
    part = {c: F.get(F.col("_p.fields"), F.lit(i)) for i, c in enumerate(columns)}
    n = F.coalesce(F.size("_p.fields"), F.lit(0))
    dated = {"year", "month", "num_day"} <= set(columns)
    reason = F.coalesce(F.col("_p.error"), F.when(n != len(columns), F.lit("column_count")), date_fault(part["year"], part["month"], part["num_day"]) if dated else F.lit(None))
    out = out.withColumn("reason", reason)
    record = F.struct(*[v.alias(c) for c, v in part.items()])
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "record_no", F.when(F.col("reason").isNull(), record).alias("record"), "reason",
        F.when(F.col("reason").isNotNull(), F.coalesce(F.col("_p.error_at"), F.col("_p.start"))).alias("reason_at"), n.alias("n_fields"),
    )


def split_dates(df: DataFrame, year: str = "year", month: str = "month", day: str = "num_day") -> DataFrame:
    """``df`` with reason: which part of the date is no valid one, null for valid rows."""
    return df.withColumn("reason", date_fault(F.col(year), F.col(month), F.col(day)))
