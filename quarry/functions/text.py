"""Expressions on texts: lines, redaction, truncation, markup."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript counts as white space, and its trimming.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Fixed value: what replaces a secret.
REDACTED = "[REDACTED]"
#: The patterns of secrets, in the order they are applied. Boundaries are ASCII ones, as in JavaScript.
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
CONNECTION = rf"(?i){_EDGE}(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|amqps)://[^{JS_SPACE}'\"]+"
AWS_KEY = rf"{_EDGE}AKIA[0-9A-Z]{{16}}{_END}"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?![A-Za-z0-9_-])"
SECRET_KEYS = r"api[_-]?key|apikey|access[_-]?key|secret[_-]?key|client[_-]?secret|token|password|passwd|pwd|secret|auth[_-]?token"
ASSIGNMENT = rf"(?i){_EDGE}((?:{SECRET_KEYS})[{JS_SPACE}]*[:=][{JS_SPACE}]*)(['\"]?)([^{JS_SPACE}'\",;]+)\2"


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def lines(s: Column) -> Column:
    """The lines of a text, with or without carriage returns."""
    return F.split(s, r"\r?\n", -1)


def nonempty_lines(s: Column) -> Column:
    return F.filter(F.transform(lines(s), js_trim), lambda x: x != "")


#: What every match of one of the patterns holds, in lower case: a text without any of these needs no pattern.
_HINTS = ("://", "akia", "eyj", "key", "token", "passw", "pwd", "secret")


def _may_hold_secret(s: Column) -> Column:
    low = F.lower(s)
    return reduce(or_, (F.contains(low, F.lit(h)) for h in _HINTS))


def redact(s: Column) -> Column:
    """The text with connection strings, access keys, web tokens and assigned secrets replaced, in that order."""
    out = F.regexp_replace(s, CONNECTION, f"$1://{REDACTED}")
    out = F.regexp_replace(out, AWS_KEY, REDACTED)
    out = F.regexp_replace(out, JWT, REDACTED)
    return F.when(_may_hold_secret(s), F.regexp_replace(out, ASSIGNMENT, f"$1{REDACTED}")).otherwise(s)


def has_secret(s: Column) -> Column:
    return _may_hold_secret(s) & (s.rlike(CONNECTION) | s.rlike(AWS_KEY) | s.rlike(JWT) | s.rlike(ASSIGNMENT))


def shortened(s: Column, most: int) -> Column:
    """At most so many characters, the last of them an ellipsis if something was cut."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def snippet(content: Column, line: Column, most: int = 20) -> Column:
    """So many lines from a line on, numbered from 1; null content gives none."""
    return F.coalesce(F.array_join(F.slice(lines(content), F.greatest(line, F.lit(1)), F.lit(most)), "\n"), F.lit(""))


def commented_out(line: Column) -> Column:
    return F.regexp_replace(line, rf"\A([{JS_SPACE}]*)", "$1// ")


def html_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def tokens(s: Column, alphabet: str = "A-Za-z0-9_$") -> Column:
    """Maximal runs of identifier characters: a name made of these occurs exactly where a token equals it."""
    return F.regexp_extract_all(s, F.lit(f"([{alphabet}]+)"), 1)


def sse_frames(buffer: Column) -> Column:
    """Data of the finished frames of an event stream; the rest of the buffer after the last blank line is open."""
    parts = F.split(buffer, "\n\n", -1)
    finished = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def data(frame: Column) -> Column:
        own = F.filter(F.split(frame, "\n", -1), lambda x: F.startswith(x, F.lit("data:")))
        return F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"\Adata:[ ]?", "")), "\n")

    return F.filter(F.transform(finished, data), lambda x: x != "")
