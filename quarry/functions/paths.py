"""Expressions on file paths and globs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names and folders that are kept out of every analysis.
SENSITIVE = [".env*", "*.pem", "*.key", "*.cert", "*.p12", "*.pfx", "*.keystore", "credentials.json", "*_credentials.json", "service-account*.json", "*secret*", ".ssh/*", ".aws/*"]
#: What is indexed, and folders of dependencies.
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
DEPENDENCY_FOLDERS = ["node_modules", "bower_components", ".pnp"]
#: Fixed value: names of test files.
TEST_FILE = r"(?i)\.(test|spec)\.[cm]?[jt]sx?$"


_WILD = re.compile(r"\*+|\?")
_MEANS = {"*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str) -> str:
    """A pattern for one glob: a star or a question mark stays within a folder, two stars or more do not."""
    literals, wild = _WILD.split(glob), _WILD.findall(glob)
    return "".join(re.escape(text) + _MEANS.get(w, ".*" if w else "") for text, w in zip(literals, [*wild, ""], strict=True))


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^/+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sensitive(path: Column, extra: list[str] | None = None) -> Column:
    """Whether a path is to be kept out. Globs with a slash match at a folder boundary, others the file's name."""
    whole = normalised(path)
    globs = [*SENSITIVE, *dict.fromkeys(g.strip() for g in extra or [] if g.strip())]
    return any_of([whole.rlike(f"(^|/){glob_regex(g)}$") if "/" in g else base_name(whole).rlike(f"^{glob_regex(g)}$") for g in globs])


@dataclass(frozen=True)
class Ignore:
    """A line of a .gitignore: a pattern, and whether it is for folders alone."""

    pattern: str
    folders: bool


def parse_gitignore(text: str) -> list[Ignore]:
    """Patterns of a .gitignore. Negations are left out; a slash before the end ties a pattern to the root."""
    found = []
    for line in map(str.strip, text.replace("\r\n", "\n").split("\n")):
        if not line or line[0] in "#!":
            continue
        body = line.removesuffix("/")
        tied = "/" in body
        found.append(Ignore(("^" if tied else "(^|/)") + glob_regex(body.removeprefix("/")) + "(/.*)?$", line.endswith("/")))
    return found


def ignored(path: Column, rules: list[Ignore], folder: bool = False) -> Column:
    return any_of([path.rlike(r.pattern) for r in rules if folder or not r.folders])


def under_ignored_folder(path: Column, rules: list[Ignore]) -> Column:
    """Whether a folder above the path is ignored."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return (F.size(parts) > 1) & F.exists(above, lambda p: ignored(p, rules, folder=True))


def indexable(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1).isin(EXTENSIONS)


def in_dependencies(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"[\\/]", -1), F.array(*map(F.lit, DEPENDENCY_FOLDERS)))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def resolved(path: Column) -> Column:
    """The path without ``.`` and ``..`` parts."""
    empty = F.array().cast("array<string>")
    step = lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).when(x == "..", done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/", -1), empty, step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")
