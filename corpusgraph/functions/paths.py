"""Paths, globs and extensions as Columns."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; the whole name of a dot file, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def normal_extension(ext: str) -> str:
    ext = ext.strip().lower()
    return ext if not ext or ext.startswith(".") else "." + ext


def extension_set(values: list[str]) -> list[str]:
    """Sorted distinct extensions; an empty value is an error."""
    out = [normal_extension(v) for v in values]
    if "" in out:
        raise ValueError("an extension is empty")
    return sorted(set(out))


def clean(path: str) -> str:
    """A path without double slashes, dots and a trailing slash."""
    out = posixpath.normpath(path) if path else "."
    return "/" + out.lstrip("/") if out.startswith("//") else out


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies under it; the root holds every absolute path."""
    p = clean(prefix)
    return path.startswith("/") if p == "/" else (path == p) | path.startswith(p + "/")


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a glob whose * and ? stop at slashes; None if it is malformed."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(pattern):
                return None
            out.append(re.escape(pattern[k]))
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                return None
            inside = pattern[k + 1 : end]
            out.append("[" + ("^/" + inside[1:] if inside[0] == "^" else inside).replace("[", r"\[").replace("&&", r"&\&") + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def glob(pattern: str, name: Column) -> Column:
    """Whether a name equals the pattern or, if that has a *, matches it as a glob."""
    test = name == pattern
    if "*" in pattern and (regex := glob_regex(pattern)):
        test = test | name.rlike(regex)
    return test


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def export_pattern(pattern: str, path: Column) -> Column:
    """'' takes all, *x an end, x* a start, anything else equality."""
    if not pattern:
        return F.lit(True)
    if pattern.startswith("*"):
        return path.endswith(pattern[1:])
    if pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    return path == pattern


def editor_noise(path: Column) -> Column:
    return base(path).rlike(r"(\.sw[pon]|~)$|^4913$|^#$|^#.*#$")


def ancestors(path: Column) -> Column:
    """A path and all directories above it, the root included."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.array_distinct(F.concat(F.array(F.lit("/")), up))
