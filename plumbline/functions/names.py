"""Names of modules and files: dotted names are hierarchies by position."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def top(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def package(name: Column) -> Column:
    """The first two parts, or the only one."""
    return F.substring_index(name, ".", 2)


def package_at(name: Column, depth: Column) -> Column:
    """The first ``depth`` parts; only the first part if there are fewer."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, F.lit(1), depth), ".")).otherwise(F.get(parts, F.lit(0)))


def path_form(name: Column) -> Column:
    return F.translate(name, ".", "/")


def file_package(path: Column) -> Column:
    """First directory of a path, ``__root__`` for a file at the top."""
    path = F.translate(path, "\\", "/")
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("__root__")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for rlike: anchored, case-sensitive, ``*`` crosses slashes."""
    body = fnmatch.translate(pattern)
    body = body.removesuffix(r"\Z").removesuffix(r"\z")
    return rf"\A{body}\z"


def literal_root(pattern: str) -> str | None:
    """First path segment of a pattern if it has no wildcard."""
    head, slash, _ = pattern.partition("/")
    return head if slash and not any(c in head for c in "*?[") else None


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common dotted prefix of the smallest and the largest member, which is that of all members."""
    a, b = F.split(low, r"\."), F.split(high, r"\.")
    n = F.least(F.size(a), F.size(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))
    return F.array_join(F.slice(a, F.lit(1), F.size(same)), ".")


def slug(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; all else becomes an underscore; 200 characters at most."""
    return F.substring(F.regexp_replace(name, r"[^a-zA-Z0-9_.-]", "_"), 1, 200)


def import_line(language: Column, module: Column) -> Column:
    return (
        F.when(language == "Java", F.concat(F.lit("import "), module, F.lit(";")))
        .when(language == "Go", F.concat(F.lit('import "'), module, F.lit('"')))
        .otherwise(F.concat(F.lit("import "), module))
    )
