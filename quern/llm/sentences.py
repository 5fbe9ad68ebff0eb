"""Sentence boundaries across languages and scripts (problem 10).

The boundary rules are compiled into a finite transducer over token classes.
Its state says whether a fence is open, which quotation is open, and what the
last mark was (full stop, abbreviation, closed quotation, ...); reading a token
it may cut before that token. Whether an opening mark has a partner is known
from a right-to-left pass whose state is the set of closing marks ahead in the
paragraph, so the pair is a bimachine.

A text of at most CHUNK characters runs through the table in one go. Longer
texts are cut into chunks at white space; each chunk is turned into its
state-transition function (all states at once) and its set of marks ahead,
functions are composed by a parallel prefix scan per document (over chunk
summaries, not over text), and every chunk then emits its boundaries from its
known state. Both ways give the same rows.

Defined results: null, empty and blank texts have no sentences; places are
code points from 0, end exclusive; repeated documents are cut alike; an
unclosed fence runs to the end of the text; a heading or list mark without
text gives no row. Texts are judged by their script, not by the lang column.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut as cut_lineage
from quern.plans.partitioning import spread

#: Characters of a text that one call goes through in one piece.
CHUNK = 65_536

# Abbreviations, without the final stop, in lower case.
#: Titles and connectors: a sentence goes on after them.
NEVER = frozenset(
    "dr dra prof mr mrs ms st sr sra srta hr messrs mgr ing lic approx ca bzw ggf vgl evtl inkl vs cf viz ej ex см ср напр тов гр проф डॉ श्री प्रो أ.د e.g i.e z.b d.h u.a p.ex p.ej s.o v.a т.е".split()
)
#: Words that a number follows: a sentence ends after them if none does.
NUMBERED = frozenset("no nos nr fig figs sec secs p pp pág págs pag art arts abschn abb kap bd vol ch chap eq núm ст стр рис табл гл т.н".split())
#: Words that may also close a sentence: it ends if a capital follows.
SOFT = frozenset("etc usw al inc ltd co jr u.s u.k u.n p.m a.m b.c др т.д т.п".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

_INVISIBLE = "­​-‏⁠﻿"


def _ranges(categories: set[str]) -> str:
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in categories]
    out = []
    for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = list(run)
        a, b = run[0][1], run[-1][1]
        out.append(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else ""))
    return "".join(out)


_MARKS = _ranges({"Mn", "Mc", "Me"})
_W = rf"[\w{_MARKS}{_INVISIBLE}]"
_TOKEN = re.compile(
    rf"""(?P<space>[ \t]+|\s+)
    |(?P<url>(?:https?|ftp|file|ssh|git|s3|mailto):/?/?[^\s"”»」]*[^\s"”»」.,;:!?。，)\]])
    |(?P<dotted>(?<!\w)(?:[A-ZА-ЯЁ]\.){{2,}}(?!\w))
    |(?P<day>(?<![\w.])[0-9]{{1,2}}\.(?=\s))
    |(?P<word>[^\W]{_W}*(?:[._/:@=&?\-'’]+(?=[a-zß-öø-ÿа-яё0-9_]){_W}+|['’](?=\w){_W}+)*)(?P<stop>\.(?!\.))?
    |(?P<ell>\.{{2,}}|…+)
    |(?P<full>[。！？।॥۔｡‼⁇⁈⁉]+)
    |(?P<strong>[!?؟]+)
    |(?P<dot>\.)
    |(?P<cont>[,;:，；：、،؛—–\-/|]+)
    |(?P<close>[)\]}}）】〉》’]+)
    |(?P<start>[¿¡]+)
    |(?P<quote>[“”„«»"「」『』])
    |(?P<other>.)""",
    re.X | re.S,
)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_HEAD = re.compile(r"[ \t]*\#{1,6}(?:[ \t]+|(?=[\r\n]|\Z))")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|[0-9]{1,9}[.)])(?:[ \t]+|(?=[\r\n]|\Z))")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})([^\r\n]*)")

_CASES = "LUMNOHT"
_QUOTES = {"“": "ldq", "”": "rdq", "„": "low", "«": "lg", "»": "rg", '"': "s", "「": "lc", "」": "rc", "『": "lw", "』": "rw"}
#: What an opening mark needs ahead to be one of a pair, and which marks close it.
_PARTNER = {"ldq": {"rdq"}, "low": {"ldq", "rdq"}, "lg": {"rg"}, "s": {"s"}, "lc": {"rc"}, "lw": {"rw"}}
_CLOSERS = {"ldq": "rdq", "low": "ldq rdq", "lg": "rg", "s": "s", "lc": "rc", "lw": "rw"}
_BIT = {k: 1 << i for i, k in enumerate(("rdq", "ldq", "rg", "s", "rc", "rw"))}

CLASSES = (
    "space break head item fence`b fence`i fence~b fence~i dot strong full ell cont close start other".split()
    + [f"{k}{c}" for k in ("word", "never", "numbered", "soft", "initial", "т", "д", "day") for c in _CASES]
    + [f"{q}{p}" for q in _QUOTES.values() for p in ("+", "-")]
)
CLASS = {name: i for i, name in enumerate(CLASSES)}
_SPACE, _BREAK, _HEADING, _LIST, _DOT, _DAY = (CLASS[x] for x in ("space", "break", "head", "item", "dot", "dayN"))
_DROPPED = {_HEADING, _LIST}
_RESETS = {_BREAK, _HEADING, _LIST, *(CLASS[f"fence{k}{b}"] for k in "`~" for b in "bi")}
_MARK_OF = {CLASS[f"{q}{p}"]: q for q in _QUOTES.values() for p in "+-"}


def _case(word: str) -> str:
    c = word[0]
    if "฀" <= c <= "๿":
        return "T"
    if "぀" <= c <= "ゟ":
        return "H"
    if c.isdigit():
        return "N"
    if c.isupper() or c.istitle():
        return "M" if word.lower() in MONTHS else "U"
    return "L" if c.islower() or c == "_" else "O"


@lru_cache(maxsize=100_000)
def _word_class(word: str, stop: bool) -> tuple[int, bool]:
    """(class, whether the stop belongs to the word)."""
    case = _case(word)
    if stop:
        low = word.lower()
        letters = sum(c.isalpha() for c in low)
        kind = "never" if low in NEVER else "soft" if low in SOFT else "numbered" if low in NUMBERED else "т" if low == "т" else "д" if low in ("д", "п") else "initial" if letters == 1 and not any(map(str.isdigit, low)) else ""
        if kind:
            return CLASS[kind + case], True
    return CLASS["word" + case], False


def tokens(text: str, offset: int = 0, line_start: bool = True, in_heading: bool = False) -> tuple[list[int], list[int], list[int]]:
    """Classes, starts and ends of a text that begins at offset; quotation marks still without partners ('-')."""
    kinds: list[int] = []
    starts: list[int] = []
    ends: list[int] = []

    def put(kind: int, a: int, b: int) -> None:
        kinds.append(kind)
        starts.append(a + offset)
        ends.append(b + offset)

    i, n = 0, len(text)
    while i < n:
        m = _LINE.match(text, i)
        end = m.end()
        if end == i:
            break
        body = end - (2 if text.startswith("\r\n", end - 2) else 1 if text[end - 1] in "\r\n" else 0)
        at = i
        if line_start:
            in_heading = False
            if not text[i:body].strip():
                put(_BREAK, i, end)
                i = end
                continue
            if fence := _FENCE.match(text, i, body):
                bare = not fence[2].strip()
                put(CLASS[f"fence{fence[1][0]}{'b' if bare else 'i'}"], fence.start(1), body if not bare else fence.end(1))
                at = body
            elif mark := _HEAD.match(text, i, end):
                in_heading = True
                at = min(mark.end(), body)
                put(_HEADING, i, at)
            elif mark := _ITEM.match(text, i, end):
                at = min(mark.end(), body)
                put(_LIST, i, at)
        for t in _TOKEN.finditer(text, at, body):
            kind = t.lastgroup
            a, b = t.span()
            if kind == "word":
                kinds.append(_word_class(t[0], False)[0])
            elif kind == "stop":
                c, whole = _word_class(text[a : b - 1], True)
                kinds.append(c)
                if not whole:
                    starts.append(a + offset)
                    ends.append(b - 1 + offset)
                    kinds.append(_DOT)
                    a = b - 1
            elif kind == "dotted":
                low = t[0][:-1].lower()
                kinds.append(CLASS[("never" if low in NEVER else "soft") + _case(t[0])])
            elif kind == "quote":
                kinds.append(CLASS[_QUOTES[t[0]] + "-"])
            elif kind == "url":
                kinds.append(CLASS["word" + _case(t[0])])
            elif kind == "day":
                kinds.append(_DAY)
            else:
                kinds.append(CLASS[kind])
            starts.append(a + offset)
            ends.append(b + offset)
        if body < end:
            put(_BREAK if in_heading else _SPACE, body, end)
        line_start, in_heading = body < end, in_heading and body == end
        i = end
    return kinds, starts, ends


def pair(kinds: list[int], ahead: int = 0) -> int:
    """Mark, from the right, the quotation marks that have a partner ahead in their paragraph; gives the marks ahead of the first token."""
    for i in range(len(kinds) - 1, -1, -1):
        k = kinds[i]
        if k in _RESETS:
            ahead = 0
        elif k in _MARK_OF:
            q = _MARK_OF[k]
            if any(ahead & _BIT[x] for x in _PARTNER.get(q, ())):
                kinds[i] = CLASS[q + "+"]
            ahead |= _BIT.get(q, 0)
    return ahead


def marks_ahead(kinds: list[int]) -> tuple[bool, int]:
    """(whether a paragraph begins in these tokens, the marks before the first such place)."""
    seen = 0
    for k in kinds:
        if k in _RESETS:
            return True, seen
        if k in _MARK_OF:
            seen |= _BIT.get(_MARK_OF[k], 0)
    return False, seen


# ------------------------------------------------------------ the transducer

_SPACED = {"dot": "dot_", "strong": "strong_", "ell": "ell_", "soft": "soft_", "qend": "qend_", "thai": "thai_", "numbered": "numbered_", "day": "day_", "т": "т_"}
#: pending mark: classes of what follows (case letters, s: ¿¡ and opening marks, o: other signs) before which is cut.
_CUTS = {
    "dot": "UMOTHs", "dot_": "UMNOTHso", "strong": "UMOTHs", "strong_": "LUMNOTHso", "full": "LUMNOTHso", "ell": "UM", "ell_": "UMs", "soft": "UM", "soft_": "UMs", "numbered": "UM", "numbered_": "UMs", "day_": "UNOTHso", "day": "", "qend": "UMNOTs", "qend_": "UMNOTso", "thai_": "T",
}
_ENDS = {"dot", "strong", "full", "ell"}

State = tuple[str, str, str]  # open fence, open quotation, pending mark


def step(state: State, name: str) -> tuple[State, bool]:
    """One move of the transducer: (next state, whether to cut before the token)."""
    fence, quote, pending = state
    if fence:
        return (("", "", "break") if name == f"fence{fence}b" else state), False
    if name.startswith("fence"):
        return (name[5], "", ""), True
    if name == "break":
        return ("", "", "break"), False
    if name in ("head", "item"):
        return ("", "", "break"), True
    if name == "space":
        return ("", quote, _SPACED.get(pending, pending)), False
    kind, case = (name[:-1], name[-1]) if name[-1] in _CASES and name[:-1] in ("word", "never", "numbered", "soft", "initial", "т", "д", "day") else (name, "")
    mark, paired = (name[:-1], name[-1] == "+") if name[-1] in "+-" and name[:-1] in _BIT.keys() | _PARTNER.keys() else ("", False)
    if pending == "break":
        (_, q, p), _ = step(("", "", ""), name)
        return ("", q, p), True
    if quote:
        if mark and mark in _CLOSERS[quote].split():
            return ("", "", "qend" if pending == "end" else ""), False
        return ("", quote, "end" if kind in _ENDS or kind == "soft" else pending if kind == "close" else ""), False
    if mark:
        opens = mark in _PARTNER and paired
        if opens or mark in ("ldq", "low", "lg", "lc", "lw"):
            cuts = "s" in _CUTS.get(pending, "")
            return ("", mark if opens else "", ""), cuts
        return ("", "", pending), False  # an end mark's closing sign without an opening one
    if kind in _ENDS:
        base = pending.rstrip("_")
        if base in ("strong", "full"):
            return ("", "", base), False
        if base == "dot" and kind == "dot":
            return ("", "", "ell"), False
        return ("", "", kind), False
    if kind == "close":
        return ("", "", pending.rstrip("_") if pending != "thai_" else ""), False
    if kind == "cont":
        return ("", "", ""), False
    sign = case or ("s" if kind == "start" else "o")
    cuts = sign in _CUTS.get(pending, "")
    if kind == "word":
        after = "thai" if case == "T" else ""
    elif kind == "д":
        after = "soft" if pending == "т_" else ""
    else:
        after = kind if kind in ("soft", "numbered", "day", "т") else ""
    return ("", "", after), cuts


@lru_cache(maxsize=1)
def machine() -> tuple[list[State], np.ndarray, np.ndarray]:
    """(states, next state [state, class], cut [state, class]); state 0 begins a text."""
    states: list[State] = [("", "", "break")]
    index = {states[0]: 0}
    rows, cuts = [], []
    for s in states:
        moves = [step(s, name) for name in CLASSES]
        for nxt, _ in moves:
            if nxt not in index:
                index[nxt] = len(states)
                states.append(nxt)
        rows.append([index[nxt] for nxt, _ in moves])
        cuts.append([c for _, c in moves])
    return states, np.array(rows, dtype=np.int32), np.array(cuts, dtype=bool)


@lru_cache(maxsize=1)
def _lists() -> tuple[list[list[int]], list[list[bool]]]:
    _, nxt, cuts = machine()
    return nxt.tolist(), cuts.tolist()


def transition(kinds: list[int]) -> np.ndarray:
    """The function of these tokens: for each state the state after them."""
    _, nxt, _ = machine()
    f = np.arange(len(nxt), dtype=np.int32)
    for k in kinds:
        f = nxt[f, k]
    return f


def run(kinds: list[int], starts: list[int], ends: list[int], state: int = 0) -> tuple[list[tuple[int, int | None, bool]], int | None]:
    """([(start, end of the visible token before it or None, kept)] of each cut, end of the last visible token)."""
    nxt, cuts = _lists()
    out: list[tuple[int, int | None, bool]] = []
    last = None
    for k, a, b in zip(kinds, starts, ends):
        if k == _SPACE:
            state = nxt[state][k]
            continue
        if cuts[state][k]:
            out.append((a, last, k not in _DROPPED))
        state = nxt[state][k]
        if k != _BREAK or state_in_fence(state):
            last = b
    return out, last


@lru_cache(maxsize=None)
def state_in_fence(state: int) -> bool:
    return bool(machine()[0][state][0])


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text that is short enough for one piece."""
    kinds, starts, ends = tokens(text)
    pair(kinds)
    cuts, last = run(kinds, starts, ends)
    out = []
    for i, (a, _, kept) in enumerate(cuts):
        b = cuts[i + 1][1] if i + 1 < len(cuts) else last
        if kept:
            piece = text[a:b]
            b = a + len(piece.rstrip())
            a += len(piece) - len(piece.lstrip())
            if b > a:
                out.append((a, b))
    return out


# ------------------------------------------------------------------- on Spark

_OUT = pa.schema([("doc_id", pa.int64()), ("char_start", pa.int32()), ("char_end", pa.int32())])
_OUT_DDL = "doc_id long, char_start int, char_end int"


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: list = []
        a: list[int] = []
        b: list[int] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x, y in spans(text):
                ids.append(doc)
                a.append(x)
                b.append(y)
        yield _batch((ids, a, b), _OUT)


def pieces(text: str, size: int) -> Iterator[tuple[int, str, bool, bool]]:
    """(offset, piece, at a line's start, in a heading) of consecutive pieces, cut after a line end or white space where there is one."""
    i, n = 0, len(text)
    while i < n:
        j = min(n, i + size)
        if j < n:
            k = text.rfind("\n", i, j)
            j = k + 1 if k >= 0 else _inside_line(text, i, j)
        line = max(text.rfind("\n", 0, i), text.rfind("\r", 0, i)) + 1
        yield i, text[i:j], line == i, line < i and bool(_HEAD.match(text, line)) and not _FENCE.match(text, line)
        i = j


def _inside_line(text: str, i: int, j: int) -> int:
    """Where to cut a piece that begins at i and has no line end before j: after white space within the line, else at its end."""
    line = max(text.rfind("\n", 0, i), text.rfind("\r", 0, i)) + 1
    if not _FENCE.match(text, line):
        seen = _VISIBLE.search(text, line)
        for x in range(j - 1, max(i, seen.start() if seen else j), -1):
            if text[x] in " \t":
                return x + 1
        for m in _BLANK_OR_END.finditer(text, j):
            if m[0] in "\r\n" or seen and m.start() > seen.start():
                j = m.end()
                return j + text.startswith("\r\n", j - 1)
        return len(text)
    end = text.find("\n", j)
    return end + 1 if end >= 0 else len(text)


_VISIBLE = re.compile(r"\S")
_BLANK_OR_END = re.compile(r"[ \t\r\n]")
_PIECE = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("at", pa.int32()), ("piece", pa.string()), ("fresh", pa.bool_()), ("heading", pa.bool_()), ("doc_id", pa.int64())])


def _cutter(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, (at, piece, fresh, heading) in enumerate(pieces(text, size)):
                    yield _batch(([key], [no], [at], [piece], [fresh], [heading], [doc]), _PIECE)

    return go


_FUNC = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("resets", pa.bool_()), ("ahead", pa.int32()), ("f", pa.list_(pa.list_(pa.int32())))])


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _FUNC]
        for doc, no, at, piece, fresh, heading in zip(*(c.to_pylist() for c in batch.columns)):
            kinds, _, _ = tokens(piece, at, fresh, heading)
            resets, ahead = marks_ahead(kinds)
            # The function depends on the marks ahead of the piece; those of the piece's own paragraphs don't.
            tail = next((i for i in range(len(kinds) - 1, -1, -1) if kinds[i] in _RESETS), -1) + 1
            head = kinds[:]
            pair(head)
            base = transition(head[:tail])
            open_marks = {q for q in (_MARK_OF.get(k) for k in kinds[tail:]) if q in _PARTNER}
            need = 0
            for q in open_marks:
                for x in _PARTNER[q]:
                    need |= _BIT[x]
            fs = []
            for mask in range(64):
                if mask & ~need:
                    fs.append(None)
                    continue
                part = kinds[tail:]
                pair(part, mask)
                fs.append(transition(part)[base].tolist())
            for c, x in zip(out, (doc, no, resets, ahead, [f if f is not None else [] for f in fs] + [[need]])):
                c.append(x)
        yield _batch(out, _FUNC)


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """State at the begin of each piece and marks ahead of its end, by prefix scans over the pieces of one document."""
    rows = rows.sort_values("no")
    n = len(rows)
    ahead = np.zeros(n, dtype=np.int32)
    mask = 0
    for i in range(n - 1, -1, -1):
        ahead[i] = mask
        mask = int(rows["ahead"].iloc[i]) | (0 if rows["resets"].iloc[i] else mask)
    fs = []
    for f, m in zip(rows["f"], ahead):
        need = int(f[64][0])
        fs.append(np.asarray(f[int(m) & need], dtype=np.int32))
    scan = np.stack(fs)
    width = 1
    while width < n:  # Hillis and Steele: after round r each row composes 2**r pieces
        moved = scan.copy()
        moved[width:] = np.take_along_axis(scan[width:], scan[:-width], axis=1)
        scan, width = moved, width * 2
    state = np.concatenate([[0], scan[:-1, 0]])
    return pd.DataFrame({"key": rows["key"].to_numpy(), "no": rows["no"].to_numpy(), "state": state.astype("int32"), "marks": ahead})


_EMIT = pa.schema([("key", pa.int64()), ("no", pa.int32()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("kept", pa.list_(pa.bool_())), ("last", pa.int32())])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _EMIT]
        for doc, no, at, piece, fresh, heading, state, marks in zip(*(c.to_pylist() for c in batch.columns)):
            kinds, starts, ends = tokens(piece, at, fresh, heading)
            pair(kinds, marks)
            cuts, last = run(kinds, starts, ends, state)
            for c, x in zip(out, (doc, no, [x[0] for x in cuts], [x[1] for x in cuts], [x[2] for x in cuts], last)):
                c.append(x)
        yield _batch(out, _EMIT)


def _long(docs: DataFrame, size: int) -> DataFrame:
    # A row's own key, fixed by the checkpoint: documents may share an id or have none.
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    cuts = cut_lineage(keyed.mapInArrow(_cutter(size), "key long, no int, at int, piece string, fresh boolean, heading boolean, doc_id long"))
    functions = cuts.drop("doc_id").mapInArrow(_functions, "key long, no int, resets boolean, ahead int, f array<array<int>>")
    known = functions.groupBy("key").applyInPandas(_scan, "key long, no int, state int, marks int")
    emitted = cut_lineage(cuts.join(known, ["key", "no"]).select("key", "no", "at", "piece", "fresh", "heading", "state", "marks").mapInArrow(_emit, "key long, no int, starts array<int>, stops array<int>, kept array<boolean>, last int"))
    # The last sentence of a piece ends before the next cut, in a later piece; only piece summaries take part.
    ahead = emitted.groupBy("key").applyInPandas(_closings, "key long, no int, close int, before int")
    rows = emitted.join(ahead, ["key", "no"]).join(cuts.filter("no = 0").select("key", "doc_id"), "key")
    size_ = F.size("starts")
    stops = F.transform(F.sequence(F.lit(0), size_ - 1), lambda i: F.when(i + 1 < size_, F.element_at("stops", i + 2)).otherwise(F.col("close")))
    one = rows.filter(size_ > 0).select("doc_id", F.explode(F.arrays_zip("starts", stops.alias("ends"), "kept")).alias("s"))
    return one.filter("s.kept and s.ends > s.starts").select("doc_id", F.col("s.starts").alias("char_start"), F.col("s.ends").alias("char_end"))


def _closings(rows: pd.DataFrame) -> pd.DataFrame:
    """For each piece the end of the sentence that its last cut begins."""
    rows = rows.sort_values("no")
    n = len(rows)
    close = np.full(n, -1, dtype=np.int32)
    lasts = [None if x is None or x != x else int(x) for x in rows["last"]]
    upto: list[int | None] = []
    seen = None
    for x in lasts:
        seen = x if x is not None else seen
        upto.append(seen)
    nxt = upto[-1] if upto else None
    for i in range(n - 1, -1, -1):
        close[i] = -1 if nxt is None else nxt
        stops = rows["stops"].iloc[i]
        if len(stops):
            first = stops[0]
            nxt = int(first) if first is not None and first == first else (upto[i - 1] if i else None)
    return pd.DataFrame({"key": rows["key"].to_numpy(), "no": rows["no"].to_numpy(), "close": close, "before": np.full(n, -1, dtype=np.int32)})


def sentences(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, char_start, char_end) of every sentence of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    short = spread(rows.filter(F.length("text") <= size)).mapInArrow(_short, _OUT_DDL)
    long = rows.filter(F.length("text") > size)
    return short.unionByName(_long(long, size)) if not long.isEmpty() else short
