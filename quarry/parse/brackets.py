"""Where brackets of a text first go wrong, from pieces of the text that are read apart.

A piece may start within a comment or a string. What it starts in is told by the pieces before it, and each of those is, for
this, a map from the state at its start to the state at its end; maps are composed in the order of the pieces. With its
state known, a piece comes down to the closing brackets that nothing in it opens and the opening ones that nothing in it
closes, up to the first that don't fit each other. In order, these summaries give what one pass over the text would give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece.
PIECE = 1 << 16
CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: What a character can be within; ``/`` and ``*`` after such a character, quotes with a backslash after one.
CODE, SLASH, LINE, BLOCK, STAR = "code", "slash", "line", "block", "star"
QUOTES = "'\"`"
STATES = [CODE, SLASH, LINE, BLOCK, STAR, *QUOTES, *(q + "\\" for q in QUOTES)]

_NEXT = re.compile(r"//|/\*|/\Z|['\"`()\[\]{}]")
_QUOTED = {q: re.compile(rf"[^{q}\\]*(?:\\.[^{q}\\]*)*{q}", re.S) for q in QUOTES}
_BACKSLASHES = re.compile(r"\\*\Z")


def _leave(text: str, state: str, at: int) -> tuple[str, int]:
    """The state and place where ``state`` is left from ``at`` on; at the end of the text, the state there."""
    if state == LINE:
        end = text.find("\n", at)
        return (CODE, end + 1) if end >= 0 else (LINE, len(text))
    if state == BLOCK:
        end = text.find("*/", at)
        if end >= 0:
            return CODE, end + 2
        return (STAR if len(text) > at and text[-1] == "*" else BLOCK), len(text)
    if found := _QUOTED[state].match(text, at):
        return CODE, found.end()
    odd = len(_BACKSLASHES.search(text, at)[0]) % 2
    return (state + "\\" if odd else state), len(text)


def scan(text: str, state: str, known: dict[int, str] | None = None, brackets: list[tuple[int, str]] | None = None) -> str:
    """The state at the end of a piece that starts in ``state``, with its brackets in code added to a list.

    ``known`` remembers end states by places in code: scans from other states mostly fall in with one that was there.
    """
    at, seen = 0, []
    if text and state in (SLASH, STAR) or len(state) == 2:
        first = text[:1]
        if state == SLASH:
            state, at = {"/": (LINE, 1), "*": (BLOCK, 1)}.get(first, (CODE, 0))
        elif state == STAR:
            state, at = (CODE, 1) if first == "/" else (BLOCK, 0)
        elif first:
            state, at = state[0], 1
    while at < len(text) or state == CODE:
        if state != CODE:
            state, at = _leave(text, state, at)
            if state != CODE:
                break
        if known is not None:
            if at in known:
                state = known[at]
                break
            seen.append(at)
        found = _NEXT.search(text, at)
        if not found:
            break
        token, at = found[0], found.end()
        if token in QUOTES:
            state = token
        elif token == "//":
            state = LINE
        elif token == "/*":
            state = BLOCK
        elif token == "/":
            state = SLASH
            break
        elif brackets is not None:
            brackets.append((found.start(), token))
        if at >= len(text):
            break
    if known is not None:
        known.update(dict.fromkeys(seen, state))
    return state


def reduced(brackets: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], list[str], tuple[int, str, str] | None]:
    """Closing brackets that nothing before opens, what is to be closed after, and the first that doesn't fit its opening
    one, with what was expected. What follows that one doesn't count."""
    closing, open_ = [], []
    for at, c in brackets:
        if c in CLOSERS:
            open_.append(CLOSERS[c])
        elif not open_:
            closing.append((at, c))
        elif open_[-1] == c:
            open_.pop()
        else:
            return closing, open_, (at, c, open_[-1])
    return closing, open_, None


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """path, piece (number), last (whether it is the only or last one), text."""
    for batch in batches:
        for k, text in enumerate(batch.column(1)):
            text = text.as_py() or ""  # noqa: PLW2901
            cuts = range(0, max(len(text), 1), size)
            for group in range(0, len(cuts), 16):
                some = cuts[group : group + 16]
                numbers = pa.array([c // size for c in some], pa.int64())
                last = pa.array([c + size >= len(text) for c in some])
                path = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(some))
                yield pa.RecordBatch.from_arrays([path, numbers, last, pa.array([text[c : c + size] for c in some], pa.string())], names=["path", "piece", "last", "text"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            known: dict[int, str] = {}
            out.append([STATES.index(scan(text, s, known)) for s in STATES])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["path", "piece", "map"])


def _summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for piece, text, state in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            found: list[tuple[int, str]] = []
            scan(text, STATES[state], None, found)
            closing, open_, error = reduced(found)
            place = lambda at: piece * size + at  # noqa: B023, E731
            misfit = {"at": place(error[0]), "found": error[1], "expected": error[2]} if error else None
            out.append(([{"at": place(a), "found": c} for a, c in closing], "".join(open_), misfit, len(text)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, (_CLOSING, pa.string(), _MISFIT, pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["path", "piece", "closing", "open", "misfit", "n"])


_CLOSING = pa.list_(pa.struct([("at", pa.int64()), ("found", pa.string())]))
_MISFIT = pa.struct([("at", pa.int64()), ("found", pa.string()), ("expected", pa.string())])
_SUMMARY = "piece long, closing array<struct<at: long, found: string>>, open string, misfit struct<at: long, found: string, expected: string>, n long"


def _first_error(rows: Iterator[tuple]) -> tuple[int, str | None, str | None] | None:
    """The first error of a text from its pieces' summaries in order."""
    open_: list[str] = []
    length = 0
    for _, _, closing, opening, misfit, n in rows:
        length += n
        for c in closing:
            if not open_:
                return c["at"], c["found"], None
            if open_[-1] != c["found"]:
                return c["at"], c["found"], open_[-1]
            open_.pop()
        if misfit:
            return misfit["at"], misfit["found"], misfit["expected"]
        open_ += opening
    return (length, None, open_[-1]) if open_ else None


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for path, own in groupby(rows, key=lambda r: r[0]):
        error = _first_error(own)
        for _ in own:
            pass
        if error:
            at, found, expected = error
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([found], pa.string()), pa.array([expected], pa.string())], names=["path", "at", "found", "expected"])


def bracket_errors(files: DataFrame, size: int = PIECE) -> DataFrame:
    """path, at, found, expected: the first closing bracket that doesn't fit, and what was expected (null where nothing was
    open); or the end of the text with what is still to be closed, found null. Input: path (each once), content.

    Brackets in comments and strings don't count; a comment or string that doesn't end is no error. Null content is empty.
    """
    kind = files.schema["path"].dataType.simpleString()
    pieces = files.select("path", "content").mapInArrow(lambda b: _pieces(b, size), f"path {kind}, piece long, last boolean, text string")
    many = pieces.where("piece > 0 OR NOT last").select("path", "piece", "text")
    maps = many.mapInArrow(_maps, f"path {kind}, piece long, map array<int>")
    # one small row per piece: a text of a gigabyte has sixteen thousand
    ordered = maps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", "map"))).alias("maps"))
    starts = ordered.mapInArrow(_starts, f"path {kind}, piece long, state int").where("piece > 0")
    placed = pieces.join(starts, ["path", "piece"], "left").select("path", "piece", "text", F.coalesce("state", F.lit(0)).alias("state"))
    found = placed.mapInArrow(lambda b: _summaries(b, size), f"path {kind}, {_SUMMARY}")
    dealt = found.repartition("path").sortWithinPartitions("path", "piece")
    return dealt.mapInArrow(_errors, f"path {kind}, at long, found string, expected string")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each piece starts: the maps before it, composed."""
    for batch in batches:
        for k, maps in enumerate(batch.column(1).to_pylist()):
            state, states = 0, []
            for m in maps:
                states.append(state)
                state = m["map"][state]
            path = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(maps))
            yield pa.RecordBatch.from_arrays([path, pa.array([m["piece"] for m in maps], pa.int64()), pa.array(states, pa.int32())], names=["path", "piece", "state"])
