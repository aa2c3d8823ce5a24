"""Tokens of JavaScript and TypeScript: names, numbers, strings, templates, patterns, punctuation, and JSX elements."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/|\A#![^\n]*)+", re.S)
_NAME = re.compile(r"[A-Za-z_$ª-￿#@][\w$ª-￿]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|\*\*=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.", re.S)
#: Words after which an expression starts, so that a slash opens a pattern and an angle an element.
BEFORE_VALUE = frozenset("return typeof case do else in of void delete throw new instanceof yield await default extends".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


class Broken(ValueError):
    """The text can't be parsed; the message says where."""


class Source:
    """A file's tokens, the partner of each bracket, and places as lines and columns from 1."""

    def __init__(self, text: str, jsx: bool = True) -> None:
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self._code(0, None)
        self.pair = self._pairs()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def line(self, i: int) -> int:
        return self.place(self.tokens[i].start)[0]

    def last_line(self, i: int) -> int:
        return self.place(self.tokens[i].end - 1)[0]

    def _fail(self, what: str, at: int) -> None:
        raise Broken(f"{what} (line {self.place(at)[0]})")

    def _value_next(self) -> bool:
        """Whether an expression may start here, by the token before."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "name":
            return t.text in BEFORE_VALUE
        return t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")

    def _code(self, at: int, until: str | None) -> int:
        """Tokens from ``at`` to the bracket that closes what stands before, or to the end."""
        text, depth = self.text, 0
        while True:
            if space := _SPACE.match(text, at):
                at = space.end()
            if at >= len(text):
                if until:
                    self._fail(f"'{until}' is missing", at)
                return at
            c = text[at]
            if text.startswith("/*", at):
                self._fail("a comment doesn't end", at)
            if c == "`":
                at = self._template(at)
            elif c in "'\"":
                found = _STRING.match(text, at) or self._fail("a string doesn't end", at)
                at = self._add("string", found.end(), at)
            elif found := _NAME.match(text, at):
                at = self._add("name", found.end(), at)
            elif c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
                at = self._add("number", _NUMBER.match(text, at).end(), at)
            elif c == "/" and self._value_next() and (found := _PATTERN.match(text, at)):
                at = self._add("pattern", found.end(), at)
            elif c == "<" and self.jsx and self._value_next() and re.match(r"<(?:[A-Za-z_$][\w.$:-]*(?=[\s/>])|>)", text[at : at + 80]) and not re.match(r"<\w+\s*(?:,|extends\b)", text[at : at + 80]):
                at = self._element(at)
            else:
                p = _PUNCT.match(text, at)[0]
                if until and p == until and not depth:
                    return self._add("punct", at + 1, at)
                if until:
                    depth += (p == _CLOSES.get(until)) - (p == until)
                at = self._add("punct", at + len(p), at)

    def _add(self, kind: str, end: int, start: int) -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end))
        return end

    def _template(self, at: int) -> int:
        """A template as one token; code within it gives tokens of its own after it."""
        start, text = at, self.text
        first = len(self.tokens)
        self.tokens.append(Token("template", "", start, start))
        at += 1
        while at < len(text) and text[at] != "`":
            if text.startswith("${", at):
                self.tokens.append(Token("punct", "{", at + 1, at + 2))
                at = self._code(at + 2, "}")
            else:
                at += 2 if text[at] == "\\" else 1
        if at >= len(text):
            self._fail("a template doesn't end", start)
        self.tokens[first].text, self.tokens[first].end = text[start : at + 1], at + 1
        return at + 1

    def _element(self, at: int) -> int:
        """A JSX element: a token that marks it, and the tokens of code within its braces."""
        start, text = at, self.text
        first = len(self.tokens)
        self.tokens.append(Token("jsx", "", start, start))
        name = re.compile(r"<\s*([\w.$:-]*)").match(text, at)
        at = name.end()
        while True:  # attributes
            if space := _SPACE.match(text, at):
                at = space.end()
            if at >= len(text):
                self._fail("an element doesn't end", start)
            if text.startswith("/>", at):
                self.tokens[first].end = at + 2
                return at + 2
            if text[at] == ">":
                at += 1
                break
            if text[at] == "{":
                self.tokens.append(Token("punct", "{", at, at + 1))
                at = self._code(at + 1, "}")
            elif text[at] in "'\"":
                end = text.find(text[at], at + 1)
                at = end + 1 if end >= 0 else self._fail("a string doesn't end", at)
            else:
                at += 1
        while at < len(text):  # children
            if text.startswith("</", at):
                end = text.find(">", at)
                if end < 0:
                    break
                self.tokens[first].end = end + 1
                return end + 1
            if text[at] == "<":
                at = self._element(at)
            elif text[at] == "{":
                self.tokens.append(Token("punct", "{", at, at + 1))
                at = self._code(at + 1, "}")
            else:
                at += 1
        self._fail("an element doesn't end", start)
        return at

    def _pairs(self) -> dict[int, int]:
        found, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in ("(", "[", "{"):
                open_.append(i)
            elif t.text in _CLOSES:
                if not open_ or self.tokens[open_[-1]].text != _CLOSES[t.text]:
                    self._fail(f"'{t.text}' closes nothing", t.start)
                found[i] = open_[-1]
                found[open_.pop()] = i
        if open_:
            self._fail(f"'{self.tokens[open_[-1]].text}' isn't closed", self.tokens[open_[-1]].start)
        return found
