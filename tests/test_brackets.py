"""First bracket errors against a stack, whatever pieces a text is cut into."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.parse import brackets

ALPHABET = list("()[]{}/*'\"`\\\nab ")


def by_stack(text):
    """One pass, character by character."""
    open_, i = [], 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if two == "//":
            i = text.find("\n", i) + 1 or len(text)
        elif two == "/*":
            end = text.find("*/", i + 2)
            i = end + 2 if end >= 0 else len(text)
        elif c in "'\"`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
            i += 1
        else:
            if c in brackets.CLOSERS:
                open_.append(brackets.CLOSERS[c])
            elif c in ")]}":
                if not open_ or open_[-1] != c:
                    return i, c, open_[-1] if open_ else None
                open_.pop()
            i += 1
    return (len(text), None, open_[-1]) if open_ else None


@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), st.integers(1, 7))
@settings(max_examples=600, deadline=None)
def test_pieces_give_what_a_stack_gives(text, size):
    state, rows = brackets.CODE, []
    for at in range(0, len(text), size):
        piece, found = text[at : at + size], []
        known = {}
        ends = {s: brackets.scan(piece, s, known) for s in brackets.STATES}
        assert ends == {s: brackets.scan(piece, s) for s in brackets.STATES}
        brackets.scan(piece, state, None, found)
        closing, open_, error = brackets.reduced([(at + i, c) for i, c in found])
        misfit = dict(zip(("at", "found", "expected"), error, strict=True)) if error else None
        rows.append((0, 0, [{"at": i, "found": c} for i, c in closing], "".join(open_), misfit, len(piece)))
        state = ends[state]
    assert brackets._first_error(iter(rows)) == by_stack(text)


@pytest.mark.parametrize("size", [3, 50, brackets.PIECE])
def test_texts(spark, size):
    rng = random.Random(size)
    texts = ["", None, "(]", "f(a[1], {b: '}'})", "(" * 500 + ")" * 499, "}" + "x" * 300, "/* ( */ ( // )\n)", "'" + "(" * 200]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts.append("[" * 100_000 + "]" * 99_999 + ")")
    files = spark.createDataFrame(list(enumerate(texts)), "path long, content string").repartition(3)
    got = {r.path: (r.at, r.found, r.expected) for r in brackets.bracket_errors(files, size).collect()}
    want = {i: e for i, t in enumerate(texts) if (e := by_stack(t or ""))}
    assert got == want
