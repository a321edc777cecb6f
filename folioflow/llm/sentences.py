"""Sentence boundaries across languages and scripts (problem 4).

The boundary rules are compiled into a finite transducer.  Its alphabet is the short list
of places that matter (end marks, quotes, brackets, line breaks, spaces between letters of
scripts without end marks), each classified by a bounded look at its neighbourhood; its
state says which quotation and how many brackets are open, whether they began the sentence,
whether anything but blanks has been seen since the last boundary, and whether closing marks of a
sentence that has ended are still being passed.  Every text of up to ``CHUNK`` characters is one
run.  A longer text is cut into chunks; each chunk is a function from the state before it to the
state after it, the functions are composed by a parallel prefix scan, and the chunks are then run
from their true states, with the same result as one run.  What is gathered of one text are a few
numbers for each chunk and sentence.

Defined cases: a null, empty or blank text has no sentences; a text without any end mark is
one sentence per line; spans never hold blanks at either end; a piece without any letter or
digit belongs to the sentence before it on its line, or is dropped if there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 1 << 16
CONTEXT = 512
LOOK = 200

SPANS = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))

# Abbreviations before a name or number, which never end a sentence.
TITLES = frozenset(
    "mr mrs ms messrs dr prof st ste rev hon gen gov sen rep capt col lt sgt maj cmdr adm pres "
    "mt ft vs viz cf etc. e.g i.e approx resp dept est fig figs vol vols ed eds "
    "sra srta dra d dña ud uds pág págs art núm "
    "mme mlle mm mgr me hr fr frl bzw usw. z.b d.h u.a sog ca vgl "
    "проф им ул гл рис стр см др. акад г-н डॉ श्री प्रो पं".split()
)
# Abbreviations of this kind only before a number.
BEFORE_NUMBER = frozenset("no nos nr p pp pág págs núm art fig vol ch sec n° стр рис § sept oct nov dec jan feb mar apr jun jul aug".split())
# Abbreviations that may end a sentence.
MAY_END = frozenset("inc corp co ltd bros jr sr u.s u.k u.n e.u d.c p.m a.m uu etc usw plc llc ag sa т.д т.п д п".split())
# German month names, which follow an ordinal with its point.
GERMAN_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
# Verbs that tie a quotation with an end mark to the words behind it.
REPORTING = frozenset(
    "said says told tells asked asks wrote writes added adds replied replies answered answers shouted cried "
    "whispered explained insisted noted noting recalled remarked declared announced continued warned argued "
    "dijo preguntó respondió añadió dit demanda répondit ajouta sagte fragte antwortete rief meinte "
    "сказал сказала спросил спросила ответил ответила добавил заметил कहा पूछा बोला".split()
)
# Words with which a new sentence begins rather than the naming of a speaker.
STARTERS = frozenset(
    "the a an he she it they we i you but and so or in at on for by is are was who what when where why how which this that these those "
    "mr mrs ms dr prof st some every neither only last more most with officials there their his her its no not as if after before then yet now "
    "el la los las un una en le les un une der die das ein eine".split()
)
REPORTING_CJK = "说道问称写答喊叫"

_THAI = "฀-๿຀-໿က-႟ក-៿"
LINE_MARKS = "\n\r  \u0085"
_END_MARKS = ".!?…。！？｡।॥؟۔։።⁇⁈⁉‼．"
_PAIRED = "\"“”„‟«»「」『』‹›()\\[\\]{}（）【】〔〕《》"
_EVENT = re.compile(f"[{LINE_MARKS}{_PAIRED}{_END_MARKS}](?:(?<=[{_END_MARKS}])[{_END_MARKS}]+)?")
_EVENT_GAPS = re.compile(f"[{LINE_MARKS}{_PAIRED}{_END_MARKS}](?:(?<=[{_END_MARKS}])[{_END_MARKS}]+)?|(?<=[{_THAI}0-9])[  ]+(?=[{_THAI}0-9])")
_GAP_SCRIPT = re.compile(f"[{_THAI}]")
_STRONG = frozenset("!?。！？｡।॥؟۔։።⁇⁈⁉‼")
_UNSPACED = frozenset("。！？｡।॥։።")
_CLOSERS = "\"”»’'」』›)]}）】〕》“"
_TOKEN_BACK = re.compile(r"[^\s\"“”„«»()\[\],;:!?]*$")
_NEXT_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\S")
_OPEN_BRACKET = frozenset("([{（【〔《")

# Symbols of the transducer's input.
LINE, END, STRAIGHT, OPEN_CURLY, CLOSE_CURLY, LOW, OPEN_GUIL, CLOSE_GUIL, OPEN_CORNER, CLOSE_CORNER, OPEN_BR, CLOSE_BR, GAP, EDGE = range(14)
_QUOTE_SYMBOL = {
    '"': STRAIGHT, "“": OPEN_CURLY, "”": CLOSE_CURLY, "‟": OPEN_CURLY, "„": LOW, "«": OPEN_GUIL, "»": CLOSE_GUIL,
    "‹": OPEN_GUIL, "›": CLOSE_GUIL, "「": OPEN_CORNER, "『": OPEN_CORNER, "」": CLOSE_CORNER, "』": CLOSE_CORNER,
}

# State: quotation (6) x it began the sentence (2) x brackets (4) x the outermost began it (2) x nothing seen yet (2);
# between chunks also: within the closing marks of a sentence that has ended (2).
NO_QUOTE, Q_STRAIGHT, Q_CURLY, Q_LOW, Q_GUIL, Q_CORNER = range(6)
STATES = 6 * 2 * 4 * 2 * 2


def pack(quote: int, quote_first: int, depth: int, bracket_first: int, fresh: int) -> int:
    return (((quote * 2 + quote_first) * 4 + depth) * 2 + bracket_first) * 2 + fresh


def unpack(state: int) -> tuple[int, int, int, int, int]:
    state, fresh = divmod(state, 2)
    state, bracket_first = divmod(state, 2)
    state, depth = divmod(state, 4)
    quote, quote_first = divmod(state, 2)
    return quote, quote_first, depth, bracket_first, fresh


START = pack(NO_QUOTE, 0, 0, 0, 1)


def _next(text: str, at: int) -> tuple[str, int]:
    """The next character on the line that is no blank, and its place; "" at the line's end and behind LOOK blanks."""
    c = text[at : at + 1]
    if c and not c.isspace():
        return c, at
    if c == " " and not text[at + 1 : at + 2].isspace():
        return text[at + 1 : at + 2], at + 1
    m = _BLANK.search(text, at, at + LOOK)
    if not m or any(c in LINE_MARKS for c in text[at : m.start()]):
        return "", at
    return m.group(), m.start()


def _behind_closers(text: str, at: int) -> int:
    """The place behind closing marks, of which at most LOOK / 4 are looked at."""
    end = min(len(text), at + LOOK // 4)
    while at < end and text[at] in _CLOSERS:
        at += 1
    return at


def _stop_ends(text: str, start: int, end: int) -> bool:
    """Whether the end marks text[start:end] can end a sentence, by what stands around them."""
    marks = text[start:end]
    follow = _behind_closers(text, end)
    nxt, at = _next(text, follow)
    if not nxt:
        return True
    direct = at == follow
    if nxt in ",;:，；：、":
        return False
    if marks != ".":
        if not _UNSPACED.isdisjoint(marks):
            return True
        if not _STRONG.isdisjoint(marks):
            return not nxt.islower() and not (direct and nxt.isalnum())
    if nxt.islower():
        return False
    if direct and follow == end and (nxt.isalnum() or nxt in "-/@&_%$€£+=*"):
        return False
    if marks != ".":  # an ellipsis
        return not nxt.islower()
    back = text.rfind(" ", max(0, start - 40), start) + 1
    if back and start - back > 6 and text[back:start].isalpha():
        return True
    token = _TOKEN_BACK.search(text, max(0, start - 40), start).group()
    low = token.lower().lstrip("'‘’-–—*")
    if not low:
        return True
    number_next = nxt.isdigit()
    if low in MAY_END:
        if number_next:
            return low not in ("co",)
        if low == "co" and text[at : at + 2] == "KG":
            return False
        if low == "sr":
            before = (text[max(0, start - len(token) - 40) : start - len(token)].split() or [""])[-1]
            return before[:1].isupper() and before not in ("El", "Al", "Del", "Un") and before[-1:].isalpha()
        if len(low) == 1:
            return low in "дп" and text[max(0, start - 4) : start - 1].strip().endswith("т.")
        return True
    if low in TITLES:
        return False
    if low in BEFORE_NUMBER and number_next:
        return False
    if len(low) == 1 and low.isalpha():
        return False
    if len(low) > 1 and low[-2] == "." and low[-1].isalpha() and low.count(".") >= 1 and all(len(p) == 1 for p in low.split(".")):
        return not number_next
    if low == "ee" and text[at : at + 2] == "UU":
        return False
    if low.isdigit() and len(low) <= 2:
        word = _NEXT_WORD.match(text, at)
        return not (word and word.group().lower() in GERMAN_MONTHS)
    return True


def _quote_ends(text: str, at: int, first: bool) -> bool:
    """Whether a sentence ends behind the closing quote or bracket text[at], given an end mark just before it."""
    i = at - 1
    while i >= max(0, at - LOOK) and text[i] in " \u00a0\u202f\u2009":
        i -= 1
    if i < max(0, at - LOOK) or not (text[i] in _STRONG or text[i] in ".…"):
        return False
    follow = _behind_closers(text, at + 1)
    nxt, place = _next(text, follow)
    if not nxt:
        return True
    if nxt.islower() or nxt in ",;:，；：、.!?。！？।-–—":
        return False
    if not first:
        return True
    words = 0
    for m in re.finditer(r"[^\W_]+|[.!?।,;:\n\"«„]", text[place : place + 120]):
        w = m.group()
        if not w[0].isalnum():
            if w != "." :
                break
            continue
        if w.lower() in REPORTING:
            return False
        words += 1
        if words > 6:
            break
    if text[i] in "!?" and nxt.isupper():
        word = _NEXT_WORD.match(text, place)
        if word and word.group().lower() not in STARTERS:
            return False
    clause = re.match("[^\\n。！？“”，,.!?]{1,16}", text[place : place + 16])
    if clause and "㐀" <= nxt <= "鿿" and any(v in clause.group() for v in REPORTING_CJK):
        return False
    return True


def _behind_run(text: str, low: int) -> int:
    """The place behind the end marks at ``low`` that belong to a run which began before."""
    while 0 < low < len(text) and text[low] in _END_MARKS and text[low - 1] in _END_MARKS:
        low += 1
    return low


def events(text: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Input symbols of text[low:high]: (start, end, symbol, whether anything but blanks stands before it since the last one).

    Where text goes on behind ``high``, what stands before the edge is told by a last symbol, EDGE.
    """
    high = len(text) if high is None else high
    seen = low = _behind_run(text, low)
    size = len(text)
    pattern = _EVENT if text.isascii() or not _GAP_SCRIPT.search(text) else _EVENT_GAPS
    for m in pattern.finditer(text, low):
        start, end = m.span()
        if start >= high:
            break
        mark = text[start]
        if mark == "." and end - start == 1 and end < size:
            # a point between letters or digits, or before a small letter, neither ends a sentence nor changes the state
            after = text[end]
            if after.isalnum() or (after == " " and end + 1 < size and text[end + 1].islower()):
                continue
        between = 1 if start > seen and not text[seen:start].isspace() else 0
        seen = end
        yield start, end, _SYMBOL.get(mark, END), between
    if seen < high < size and not text[seen:high].isspace():
        yield high, high, EDGE, 1


def decide(text: str, start: int, end: int, symbol: int, first: int) -> int:
    """Whether a sentence may end behind the symbol, by the characters around it."""
    if symbol == END:
        return int(_stop_ends(text, start, end))
    if symbol == GAP:
        return int(not (text[start - 1].isdigit() and text[end].isdigit()))
    return int(_quote_ends(text, start, bool(first)))


def _step(state: int, symbol: int, between: int, ends: int) -> tuple[int, bool]:
    """The next state, and whether a sentence ends behind this symbol."""
    quote, quote_first, depth, bracket_first, fresh = unpack(state)
    if between:
        fresh = 0
    if symbol == LINE:
        return START, True
    if symbol == EDGE:
        return pack(quote, quote_first, depth, bracket_first, fresh), False
    if symbol in (END, GAP):
        if ends and quote == NO_QUOTE and depth == 0:
            return START, True
        return pack(quote, quote_first, depth, bracket_first, fresh if symbol == GAP else 0), False
    if symbol == OPEN_BR:
        return pack(quote, quote_first, min(3, depth + 1), bracket_first if depth else fresh, 0), False
    if symbol == CLOSE_BR:
        if depth == 1 and quote == NO_QUOTE and bracket_first and ends:
            return START, True
        return pack(quote, quote_first, max(0, depth - 1), bracket_first if depth > 1 else 0, 0), False
    if _closes(quote, symbol):
        if depth == 0 and ends:
            return START, True
        return pack(NO_QUOTE, 0, depth, bracket_first, 0), False
    opened = {STRAIGHT: Q_STRAIGHT, OPEN_CURLY: Q_CURLY, LOW: Q_LOW, OPEN_GUIL: Q_GUIL, OPEN_CORNER: Q_CORNER}.get(symbol)
    if quote == NO_QUOTE and opened is not None:
        return pack(opened, fresh, depth, bracket_first, 0), False
    return pack(quote, quote_first, depth, bracket_first, 0), False


def _closes(quote: int, symbol: int) -> bool:
    return symbol in {Q_STRAIGHT: (STRAIGHT,), Q_CURLY: (CLOSE_CURLY,), Q_LOW: (OPEN_CURLY, CLOSE_CURLY, STRAIGHT), Q_GUIL: (CLOSE_GUIL,), Q_CORNER: (CLOSE_CORNER,)}.get(quote, ())


def _compile() -> tuple[list[list[int]], list[list[int]]]:
    """The transducer as tables: next state (plus ``CUT`` where a sentence ends) by state and symbol * 4 + between * 2 + ends;
    and by state and symbol: 0 if the neighbourhood does not matter, 1 if it does, 2 if it does as the first thing of a sentence."""
    table, asks = [], []
    for state in range(STATES):
        quote, quote_first, depth, bracket_first, _ = unpack(state)
        row, ask = [], []
        for symbol in range(SYMBOLS):
            for between in (0, 1):
                for ends in (0, 1):
                    after, cut = _step(state, symbol, between, ends)
                    row.append(after + CUT * cut)
            if symbol in (END, GAP):
                ask.append(int(quote == NO_QUOTE and depth == 0))
            elif symbol == CLOSE_BR:
                ask.append(2 * int(depth == 1 and quote == NO_QUOTE and bracket_first))
            else:
                ask.append((1 + quote_first) * int(_closes(quote, symbol) and depth == 0))
        table.append(row)
        asks.append(ask)
    return table, asks


CUT = 1 << 10
SYMBOLS = 14
_SYMBOL = _QUOTE_SYMBOL | dict.fromkeys(LINE_MARKS, LINE) | dict.fromkeys(" \u00a0", GAP) | dict.fromkeys("([{（【〔《", OPEN_BR) | dict.fromkeys(")]}）】〕》", CLOSE_BR)
TABLE, ASKS = _compile()


def _closing(text: str, at: int, symbol: int) -> int:
    """End of a sentence that ends with the symbol ending at ``at``: closing quotes and brackets count."""
    if symbol in (LINE, GAP):
        return at
    while at < len(text) and text[at] in _CLOSERS:
        if text[at] == "“" and at + 1 < len(text) and (text[at + 1].isalnum()):
            break
        if text[at] == '"' and at + 1 < len(text) and text[at + 1].isalnum():
            break
        at += 1
    return at


def cuts(text: str, state: int, low: int = 0, high: int | None = None) -> tuple[list[int], int]:
    """Places in text[low:high] where sentences end, and the state behind it; a state of STATES or more is within closing marks."""
    places: list[int] = []
    high = len(text) if high is None else high
    skip, reached = -1, False
    if state >= STATES:
        state -= STATES
        skip, reached = _closing(text, _behind_run(text, low), END), True
    for start, end, symbol, between in events(text, low, high):
        if start < skip and symbol != EDGE:
            continue
        if reached and symbol != EDGE:
            places.append(skip)
            reached = False
        ask = ASKS[state][symbol]
        ends = decide(text, start, end, symbol, ask == 2) if ask else 0
        state = TABLE[state][symbol * 4 + between * 2 + ends]
        if state >= CUT:
            state -= CUT
            if symbol == LINE:
                places.append(start)
                places.append(end)
            else:
                skip, reached = _closing(text, end if symbol != GAP else start, symbol), True
    if reached and (skip <= high or high == len(text)):
        places.append(skip)
        reached = False
    return places, state + STATES * reached


def spans_between(text: str, places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    last = 0
    for place in [*places, len(text)]:
        if place <= last:
            continue
        piece = text[last:place]
        start = last + len(piece) - len(piece.lstrip())
        end = place - (len(piece) - len(piece.rstrip()))
        if end > start:
            if text[start].isalnum() or text[end - 2 : end - 1].isalnum() or any(c.isalnum() for c in text[start:end]):
                out.append((start, end))
            elif out and "\n" not in text[out[-1][1] : start] and "\r" not in text[out[-1][1] : start]:
                out[-1] = (out[-1][0], end)
        last = place
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of one text."""
    if not text or text.isspace():
        return []
    places, _ = cuts(text, START)
    return spans_between(text, places)


def transition(text: str, low: int, high: int) -> np.ndarray:
    """The chunk text[low:high] as a function: for every state before it, the state behind it."""
    passing = _closing(text, _behind_run(text, low), END)
    at = [(s, -1) for s in range(STATES)] + [(s, passing) for s in range(STATES)]
    for start, end, symbol, between in events(text, low, high):
        after: dict[tuple[int, int], tuple[int, int]] = {}
        for now in set(at):
            state, skip = now
            if start < skip and symbol != EDGE:
                after[now] = now
                continue
            ask = ASKS[state][symbol]
            to = TABLE[state][symbol * 4 + between * 2 + (decide(text, start, end, symbol, ask == 2) if ask else 0)]
            if to < CUT:
                after[now] = (to, skip)
            else:
                after[now] = (to - CUT, skip if symbol == LINE else _closing(text, start if symbol == GAP else end, symbol))
        at = [after[x] for x in at]
    return np.array([s + STATES * (skip > high and high < len(text)) for s, skip in at], dtype=np.int16)


def prefix_states(functions: np.ndarray, start: int = START) -> np.ndarray:
    """State before each chunk, by a parallel prefix scan (recursive doubling) over the chunks' functions."""
    scan = np.array(functions, dtype=np.int64)
    n, hop = len(scan), 1
    while hop < n:
        later = np.take_along_axis(scan[hop:], scan[:-hop], axis=1)
        scan = np.concatenate([scan[:hop], later])
        hop *= 2
    return np.concatenate([[start], scan[:-1, start]]) if n else np.array([], dtype=np.int64)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and text to keys and spans."""
    for batch in batches:
        found = [sentence_spans(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        places = np.array([x for spans in found for x in spans], dtype=np.int32).reshape(-1, 2)
        keys = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(places[:, 0]), pa.array(places[:, 1])], names=[*batch.schema.names[:-1], "start_char", "end_char"])


def _split(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Texts to chunks, each with what stands around it."""
    for pdf in batches:
        for row, text in zip(pdf["_row"], pdf["_text"]):
            for k, low in enumerate(range(0, len(text), chunk)):
                lead = min(CONTEXT, low)
                yield pd.DataFrame({"_row": [row], "_k": [k], "_lead": [lead], "_n": [min(chunk, len(text) - low)], "_piece": [text[low - lead : low + chunk + CONTEXT]]})


def _chunk_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({
            "_row": pdf["_row"], "_k": pdf["_k"],
            "_f": [transition(p, lead, lead + n).tolist() for p, lead, n in zip(pdf["_piece"], pdf["_lead"], pdf["_n"], strict=True)],
        })


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_k")
    states = prefix_states(np.array(pdf["_f"].tolist(), dtype=np.int64))
    return pd.DataFrame({"_row": pdf["_row"], "_k": pdf["_k"], "_state": states.astype("int32")})


def parts(text: str, places: list[int], low: int, high: int, shift: int) -> list[tuple[int, int, bool, bool, bool, bool]]:
    """The stretches of text[low:high] between the places: (first place that is no blank, end of the last, letters or digits, a
    line break before, a line break behind, ends at a place); of a blank stretch both places are -1."""
    out = []
    last = low
    for i, place in enumerate([*places, high]):
        if place < last:
            continue
        piece = text[last:place]
        bare = piece.strip()
        if bare:
            start = last + len(piece) - len(piece.lstrip())
            end = start + len(bare)
            before, behind = text[last:start], text[end:place]
            some = any(c.isalnum() for c in bare)
            out.append((start + shift, end + shift, some, "\n" in before or "\r" in before, "\n" in behind or "\r" in behind, i < len(places)))
        elif piece or i < len(places):
            line = "\n" in piece or "\r" in piece
            out.append((-1, -1, False, line, line, i < len(places)))
        last = place
    return out


def joined(stretches: list[tuple[int, int, bool, bool, bool, bool]]) -> list[tuple[int, int]]:
    """Spans of the sentences from the stretches of all chunks in order, as ``spans_between`` has them from the text."""
    out: list[tuple[int, int]] = []
    line = False
    start = end = -1
    some = before = behind = False
    for a, z, letters, line_before, line_behind, ends in [*stretches, (-1, -1, False, False, False, True)]:
        if a >= 0:
            if start < 0:
                start, before = a, behind or line_before
            end, behind = z, line_behind
            some = some or letters
        else:
            behind = behind or line_before
        if not ends:
            continue
        if start >= 0:
            line = line or before
            if some:
                out.append((start, end))
                line = False
            elif out and not line:
                out[-1] = (out[-1][0], end)
        line = line or behind
        start, end, some, before, behind = -1, -1, False, False, False
    return out


def _chunk_parts(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for piece, lead, n, state, k in zip(pdf["_piece"], pdf["_lead"], pdf["_n"], pdf["_state"], pdf["_k"], strict=True):
            places, _ = cuts(piece, int(state), lead, lead + n)
            out.append(parts(piece, places, lead, lead + n, int(k) * chunk - lead))
        yield pd.DataFrame({"_row": pdf["_row"], "_k": pdf["_k"], "_parts": out})


PARTS = "array<struct<a:long,z:long,letters:boolean,before:boolean,behind:boolean,ends:boolean>>"


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    spans = joined([tuple(p.values()) if isinstance(p, dict) else tuple(p) for ps in pdf.sort_values("_k")["_parts"] for p in ps])
    return pd.DataFrame({"_row": pdf["_row"].iloc[0], "start_char": [a for a, _ in spans], "end_char": [z for _, z in spans]})


def sentences(df: DataFrame, keys: list[str], text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``keys``, start_char, end_char of every sentence of every row; offsets in characters, end exclusive.

    Rows of up to ``chunk`` characters take one pass without a shuffle.  Longer ones, each distinct one once, are split,
    composed and joined again; equal rows give equal, repeated rows.
    """
    src = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kept = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    size = F.length("_text")
    short = src.where(size <= chunk).select(*kept, "_text")
    schema = T.StructType([*short.schema.fields[:-1], *SPANS.elementType.fields])
    spans = short.mapInArrow(_short, schema)
    long = src.where(size > chunk).withColumn("_row", F.xxhash64("_text"))
    once = long.groupBy("_row", "_text").agg(F.lit(1)).select("_row", "_text")
    pieces = once.mapInPandas(lambda b: _split(b, chunk), "_row long, _k int, _lead int, _n int, _piece string").repartition("_row", "_k")
    functions = pieces.mapInPandas(_chunk_functions, "_row long, _k int, _f array<int>")
    states = functions.groupBy("_row").applyInPandas(_compose, "_row long, _k int, _state int")
    stretches = pieces.join(states, ["_row", "_k"]).mapInPandas(lambda b: _chunk_parts(b, chunk), f"_row long, _k int, _parts {PARTS}")
    found = stretches.groupBy("_row").applyInPandas(_together, "_row long, start_char int, end_char int")
    split = long.drop("_text").join(found, "_row").select(*kept, "start_char", "end_char")
    return spans.unionByName(split)
