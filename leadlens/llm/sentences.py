"""Problem 10: sentence units with their places, in many languages and scripts.

Method: the boundary rules are compiled into a finite transducer. A lexer turns the characters that
can matter into a few symbols (end of paragraph, list mark, end mark, opening and closing quote or
bracket, blank between Thai letters); the transducer's state is the quote or bracket it stands in.
All documents of a batch are cut into chunks of ``CHUNK`` symbols that run side by side. Of a
document with several chunks each chunk is first taken as a function from state to state, and a
parallel prefix scan over these functions gives the state every chunk begins in, so a very long
document takes no longer chain of steps than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK = 64

# Abbreviations that never end a sentence, and those that may (before a capital letter).
NEVER = set(
    "St No Nr Fig Figs Abb Dr Mr Mrs Ms Prof Dept Cf cf vs approx min max e.g i.e eg ie env ca bzw z d p ex resp incl excl Vol vol pp Art Sec "
    "Gen Rev Hon Sr Mt Ft Tel Str zzgl vgl Hr Fr sog evtl M Mme Mlle т им ул стр рис см напр".split()
)
SOMETIMES = set("etc Ltd Co Inc Corp pcs in a.m p.m U.S U.K al ft lb oz Jr B h u usw г гг тыс млн млрд руб е д p.ex z.B d.h т.е т.д т.п".split())
# German months, before which a number with a full stop is an ordinal.
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Chinese words after which a sentence goes on behind its quotation.
GOES_ON = ("随后", "然后", "接着", "而后", "后来", "并且", "几个")
# Opening and closing marks; the brackets come last.
QUOTES = ["“”", "‘’", "«»", "„“", "「」", "『』", '""', "''", "()", "（）", "[]", "【】"]
FIRST_BRACKET = 8

_CLOSERS = "\"'”’»›)\\]）］】」』〉》"
_HIDDEN = "\u00ad\u034f\u200b-\u200d\u2060-\u2064\ufe00-\ufe0f\ufeff"
_CLOSING = rf"[{_CLOSERS}{_HIDDEN}]|“(?=[\s,.;:!?)]|$)|[*_]+(?=\s|$)"
_SKIPPED = regex.compile(rf"[\s{_HIDDEN}]*")
_HARD = "。！？｡।॥"
_SOFT = ".!?؟۔…"
_TERMINAL = regex.compile(rf"[{_HARD}{_SOFT}]+(?:{_CLOSING}|[^\S\n]»)*")
_RUN = regex.compile(rf"(?:{_CLOSING})*")
_LEX = regex.compile(
    rf"(?P<para>\n[^\S\n]*\n)|(?P<list>(?m:^)[^\S\n]*(?:-[ \t]|\d{{1,3}}\.[ \t])(?=[^\n]*\S))|(?P<thai>(?<=[\p{{Thai}}--[๐-๙฿]])\s+(?=[\p{{Thai}}--[๐-๙฿]]))"
    rf"|(?P<term>[{_HARD}{_SOFT}]+)|(?P<quote>[“”‘’«»„「」『』\"'()（）\[\]【】])",
    regex.V1,
)
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Devanagari}\p{Arabic}\p{Hebrew}\p{Lo}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}。！？」』”]")
_START = regex.compile(r"\p{Lu}|\p{Lt}|\p{Ll}\p{Lu}|\p{N}|[“‘«„「『\"'(（\[【¿¡*_#<{{@&]|[\p{Sc}\p{So}\p{Extended_Pictographic}]")
_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}.]*$")
_NEXT = regex.compile(r"\s+(\p{L}[\p{L}.]*)\.")
_ORDINAL = regex.compile(rf"\s+(?:{MONTHS})\b")

# symbols
PAD, PARA, LIST, BREAK, END, OPEN = range(6)
CLOSE = OPEN + 2 * len(QUOTES)
SYMBOLS = CLOSE + 3 * len(QUOTES)
STATES = 1 + 2 * len(QUOTES)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary) by state and symbol. State 0 is outside; 1 + 2 t + c is inside mark t, c after a colon."""
    step = np.tile(np.arange(STATES)[:, None], (1, SYMBOLS))
    out = np.zeros((STATES, SYMBOLS), bool)
    for always in (PARA, LIST, BREAK):
        step[:, always], out[:, always] = 0, True
    step[:, BREAK] = np.arange(STATES)
    out[0, END] = True
    for t in range(len(QUOTES)):
        for colon in (0, 1):
            step[0, OPEN + 2 * t + colon] = 1 + 2 * t + colon
            for then in (0, 1, 2):  # goes on; ends if after a colon; ends
                step[1 + 2 * t + colon, CLOSE + 3 * t + then] = 0
                out[1 + 2 * t + colon, CLOSE + 3 * t + then] = then == 2 or (then == 1 and colon == 1)
    return step.astype(np.int16), out


STEP, OUT = _compile()


def _follows(text: str, at: int) -> tuple[str, bool]:
    """What comes at ``at``: "end", "start" of a sentence, "caseless" letter or "on"; and whether a blank is before it."""
    low, at = at, _SKIPPED.match(text, at).end()
    blank = any(c.isspace() for c in text[low:at])
    if at == len(text):
        return "end", True
    if _CASELESS.match(text, at):
        return "caseless", blank
    return ("start" if _START.match(text, at) else "on"), blank


def _ends(text: str, mark: str, begin: int, after: int) -> bool:
    """Whether the end marks ``mark``, at ``begin``, end a sentence whose closing marks run up to ``after``."""
    if any(c in _HARD for c in mark):
        return True
    follows, blank = _follows(text, after)
    if follows == "end":
        return True
    if not blank:
        return follows == "caseless" and mark[0] in "!?؟" or (follows == "caseless" and mark == "." and begin > 0 and bool(_CJK.match(text, begin - 1)))
    if mark.strip("…") == "" or (len(mark) > 1 and mark.strip(".") == ""):
        return follows == "start" and after == begin + len(mark) and not text[after:].lstrip()[:1].isdigit()
    if mark == ".":
        word = _WORD.search(text, max(0, begin - 24), begin)
        if word:
            w = word.group()
            if w in NEVER or (len(w) == 1 and w not in SOMETIMES and w.isupper()):
                return False
            if w in SOMETIMES:
                if (near := _NEXT.match(text, after)) and near.group(1) in NEVER | SOMETIMES:
                    return False
                return follows == "start" and (w in ("etc", "a.m", "p.m") or not (len(w) == 1)) and not text[after:].lstrip()[:1].isdigit()
        elif begin and text[begin - 1].isdigit() and _ORDINAL.match(text, after):
            return False
    return follows in ("start", "caseless")


def symbols(text: str) -> tuple[list[int], list[int]]:
    """(symbols, boundary places) of a text."""
    found: list[list[int]] = []  # [symbol, place, mark]
    skip = -1
    for m in _LEX.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind == "para":
            found.append([PARA, at, -1])
        elif kind == "list":
            found.append([LIST, m.end() - len(m.group().lstrip()), -1])
            skip = m.end()
        elif kind == "thai":
            found.append([BREAK, at, -1])
        elif kind == "term":
            if at < skip:
                continue
            after = _TERMINAL.match(text, at).end()
            if _ends(text, m.group(), at, after):
                found.append([END, after, -1])
        else:
            c = m.group()
            before = text[at - 1] if at else " "
            behind = text[at + 1] if at + 1 < len(text) else " "
            if c in "'’" and before.isalnum() and behind.isalnum():
                continue
            if c in "\"'":
                mark = 6 if c == '"' else 7
                opens = (before.isspace() or before in "([{（:：=“「") and not behind.isspace()
                closes = not before.isspace() and (not behind.isalnum())
                if not opens and not closes:
                    opens, closes = c == '"', False
            else:
                mark = next((t for t, pair in enumerate(QUOTES) if c in pair and t not in (3, 6, 7)), -1)
                opens = mark >= 0 and c == QUOTES[mark][0]
                closes = not opens
                if c == "„":
                    mark, opens, closes = 3, True, False
                elif c == "“":  # closes a German quotation, opens others
                    closes = behind.isspace() or behind in ",.;:!?)"
                    opens = not closes
            if opens:
                lead = text[max(0, at - 3) : at].rstrip()[-1:]
                found.append([OPEN + 2 * mark + (lead in (":", "：", "，", ",") and lead != ""), at, mark])
            if closes:
                for t in [mark] if c not in "“”" else [3] if c == "“" else [0, 3]:
                    found.append([CLOSE + 3 * t + _after_close(text, at, t), _past(text, at), t])
    return _matched(found)


def _past(text: str, at: int) -> int:
    """The place after the run of closing marks that holds ``at``."""
    return _RUN.match(text, at + 1).end()


def _after_close(text: str, at: int, mark: int) -> int:
    """0 if the sentence goes on after a closing mark, 1 if it ends where a colon led to the quotation, 2 if it ends."""
    low = at - 1
    while low >= 0 and (text[low].isspace() or text[low] in "\"'”’»)]）」』"):
        low -= 1
    if low < 0 or text[low] not in _HARD + _SOFT:
        return 0
    after = _past(text, at)
    follows, blank = _follows(text, after)
    if follows == "end":
        return 2
    wide = text[low] in "。！？｡"
    if mark >= FIRST_BRACKET:
        return 2 if follows == "caseless" or (follows == "start" and (blank or wide)) else 0
    if follows == "caseless" or (wide and follows == "start"):
        rest = text[after : after + 8].lstrip()
        return 0 if rest.startswith(GOES_ON) else 1
    return 2 if follows == "start" and blank else 0


def _matched(found: list[list[int]]) -> tuple[list[int], list[int]]:
    """Right to left: only openings that are closed before the paragraph ends stay openings."""
    closing: set[int] = set()
    keep = []
    for item in reversed(found):
        symbol, _, mark = item[:3]
        if symbol in (PARA, LIST):
            closing = set()
        elif symbol >= CLOSE:
            closing.add(mark)
        elif symbol >= OPEN and mark not in closing:
            continue
        keep.append(item)
    keep.reverse()
    return [k[0] for k in keep], [k[1] for k in keep]


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def run(rows: list[list[int]]) -> list[np.ndarray]:
    """For the symbols of every document: at which of them a boundary is."""
    sizes = np.array([len(r) for r in rows])
    chunks = np.maximum(1, -(-sizes // CHUNK))
    first = np.concatenate([[0], np.cumsum(chunks)])
    grid = np.zeros((first[-1], CHUNK), np.int16)
    for i, r in enumerate(rows):
        grid[first[i] : first[i + 1]].reshape(-1)[: len(r)] = r
    begin = np.zeros(first[-1], np.int64)
    several = np.flatnonzero(chunks > 1)
    if len(several):
        # every chunk as a function of the state it begins in
        places = np.concatenate([np.arange(first[i], first[i + 1]) for i in several])
        inside = np.concatenate([np.arange(chunks[i]) for i in several])
        f = np.tile(np.arange(STATES, dtype=np.int16), (len(places), 1))
        for t in range(CHUNK):
            f = STEP[f, grid[places, t][:, None]]
        stride = 1
        while stride <= inside.max():  # inclusive prefix scan
            on = np.flatnonzero(inside >= stride)
            f[on] = _compose(f[on - stride], f[on])
            stride *= 2
        later = np.flatnonzero(inside > 0)
        begin[places[later]] = f[later - 1, 0]
    state, out = begin, np.zeros(grid.shape, bool)
    for t in range(CHUNK):
        out[:, t] = OUT[state, grid[:, t]]
        state = STEP[state, grid[:, t]].astype(np.int64)
    return [np.flatnonzero(out[first[i] : first[i + 1]].reshape(-1)[: sizes[i]]) for i in range(len(rows))]


def units(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """(start, end) of the units of every text: code points from 0, end exclusive, without outer white space."""
    lexed = [symbols(t) if t else ([], []) for t in texts]
    result = []
    for text, (_, places), hits in zip(texts, lexed, run([s for s, _ in lexed])):
        spans, low = [], 0
        for cut in [*sorted({places[i] for i in hits}), len(text or "")]:
            part = (text or "")[low:cut]
            bare = part.strip()
            if bare:
                begin = low + len(part) - len(part.lstrip())
                spans.append((begin, begin + len(bare)))
            low = cut
        result.append(spans)
    return result


def sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, start_pos, end_pos)``: one row per unit.

    Null, empty and blank texts have no units; copies of a row have theirs each. Other columns are
    not read.
    """
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                found = units(part.column(1).to_pylist())
                sizes = np.array([len(f) for f in found])
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
                places = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([keys, pa.array(places[:, 0].copy()), pa.array(places[:, 1].copy())], names=[key, "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(split, f"`{key}` {kind}, start_pos int, end_pos int")
