"""Sections of a label. Lines are tagged with the headings of each kind, then slices between tags are cut.

A section begins at a line with one of its kind's headings. It ends before a line that a stop pattern or, once there
is some body, another heading fits, before two blank lines or a blank last line, and after the kind's most lines.
The tagging is a small Python function over one text at a time: as expressions, some hundred patterns over every line
took longer to plan than to run.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex.functions import patterns as P

SECTION = "struct<kind:string,heading:string,body:string,start_line:int,end_line:int>"
BLANK = " \t\n\r\x0b\x0c"


def trimmed(s: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(s, F.lit(BLANK))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _compiled(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns) or r"(?!)", re.I | re.A)


_KINDS = [(kind, _compiled(heads), [re.compile(p, re.I | re.A) for p in heads], _compiled(stops), most) for kind, heads, stops, most in P.SECTIONS]


def rest_of(line: str, headings: list[re.Pattern]) -> str:
    """The line without the heading match that ends farthest right; the first of those listed wins a tie."""
    start, stop = max((m.span() for p in headings if (m := p.search(line))), key=lambda s: s[1])
    return (line[:start] + line[stop:]).strip(BLANK)


#: Lines that a worker keeps what it found in, as labels share many of theirs, and how long such a line may be.
KEPT_LINES, KEPT_CHARS = 8_000, 200


def _rests(line: str) -> tuple[tuple[int, str], ...]:
    """The kinds of which the line has a heading, each with the line without it; most lines have none, and share one empty tuple."""
    return tuple((k, rest_of(line, headings)) for k, (_, head, headings, _, _) in enumerate(_KINDS) if line.strip(BLANK) and head.search(line))


def _stops(line: str) -> int:
    """The kinds whose sections the line ends, as bits."""
    return sum(1 << k for k, (_, _, _, stop, _) in enumerate(_KINDS) if stop.search(line))


_kept_rests, _kept_stops = lru_cache(KEPT_LINES)(_rests), lru_cache(KEPT_LINES)(_stops)


def found(text: str) -> list[dict]:
    """The first section of each kind that has a body, or is a declaration of its own."""
    lines = text.split("\n")
    texts, n, out = [x.strip(BLANK) for x in lines], len(lines), []
    known: list[dict[int, str]] = [{} for _ in _KINDS]
    for i, x in enumerate(lines):
        for k, rest in _kept_rests(x) if len(x) <= KEPT_CHARS else _rests(x):
            known[k][i] = rest
    stops = lambda j, k: _kept_stops(lines[j]) >> k & 1 if len(lines[j]) <= KEPT_CHARS else bool(_KINDS[k][3].search(lines[j]))
    for k, (kind, _, _, _, most) in enumerate(_KINDS):
        rests = known[k]
        for i, rest in rests.items():
            after = range(i + 1, min(n, i + most + 1))
            since = i if rest else next((j for j in after if texts[j]), n)  # a heading beyond this line ends the section
            ends = (j for j in after if (stops(j, k) or j in rests and j > since if texts[j] else not "".join(texts[j + 1 : j + 2])))
            inside = [j for j in range(i + 1, next(ends, after.stop)) if texts[j]]
            body = "\n".join([rest] * bool(rest) + [texts[j] for j in inside])
            if body or kind in P.DECLARATIONS:
                out.append({"kind": kind, "heading": None if kind in P.DECLARATIONS else texts[i], "body": body or texts[i], "start_line": i, "end_line": max(inside, default=i)})
                break
    return out


def sections(text: Column) -> Column:
    """array of SECTION: the first section of each kind, in the order of the kinds; null for null."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("heading", pa.string()), ("body", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))

    @F.arrow_udf(f"array<{SECTION}>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else found(t) for t in texts.to_pylist()], kind)

    return read.asNondeterministic()(text)  # or Spark would put the call inside the expressions over its result
