"""Paths, permissions and patterns."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(name: Column) -> Column:
    """The last suffix in lower case; null for dotfiles and names without one."""
    found = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return F.when(found != "", found)


def mode_string(mode: Column) -> Column:
    """``rw-r--r--`` for the permission bits."""
    letters = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, F.lit("rwx"[i % 3])).otherwise(F.lit("-")) for i in range(9)]
    return F.when(mode.isNotNull(), F.concat(*letters))


def mode_octal(mode: Column) -> Column:
    octal = F.conv(mode.cast("string"), 10, 8)
    return F.when(F.length(octal) < 4, F.lpad(octal, 4, "0")).otherwise(octal)


# ---------------------------------------------------------------- patterns


def glob_regex(pattern: str) -> str:
    """A regular expression of the whole subject: ``*`` and ``?`` stay within a segment, ``**`` does not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "*":
            double = pattern[i : i + 2] == "**"
            out += ".*" if double else "[^/]*"
            i += 2 if double else 1
        else:
            out += "[^/]" if pattern[i] == "?" else re.escape(pattern[i])
            i += 1
    return rf"(?s)\A{out}\z"


class Excludes:
    """Patterns in the manner of rsync: without a slash they meet the name at any depth, with one the whole relative
    path; a slash at the end means directories only."""

    def __init__(self, patterns: list[str]):
        self.rules: list[tuple[str, bool, bool]] = []  # (regex, directories only, whole path)
        for p in patterns:
            p = p.strip()
            only_dirs = p.endswith("/")
            p = p.rstrip("/")
            whole = "/" in p
            if p := p.lstrip("/"):
                self.rules.append((glob_regex(p), only_dirs, whole))

    def matches(self, rel_path: str, is_dir: bool) -> bool:
        name = rel_path.rpartition("/")[2]
        return any((is_dir or not only) and re.match(rx.replace(r"\z", r"\Z"), rel_path if whole else name) for rx, only, whole in self.rules)

    def prunes(self, rel_path: str, is_dir: bool = False) -> bool:
        """Also true if one of the directories above is excluded."""
        parts = rel_path.split("/")
        above = any(self.matches("/".join(parts[:i]), True) for i in range(1, len(parts)))
        return above or self.matches(rel_path, is_dir)

    @staticmethod
    def _folder_test(rx: str, whole: bool):
        return lambda folder: (folder if whole else file_name(folder)).rlike(rx)

    def column(self, rel_path: Column, is_dir: bool = False) -> Column:
        """The same for a column of relative file paths, without Python in the tasks."""
        tests = []
        above = F.transform(F.sequence(F.lit(1), F.size(F.split(rel_path, "/")) - 1), lambda i: F.array_join(F.slice(F.split(rel_path, "/"), 1, i), "/"))
        above = F.when(F.size(F.split(rel_path, "/")) > 1, above).otherwise(F.array().cast("array<string>"))
        for rx, only, whole in self.rules:
            if not only or is_dir:
                tests.append((rel_path if whole else file_name(rel_path)).rlike(rx))
            tests.append(F.exists(above, self._folder_test(rx, whole)))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


# ---------------------------------------------------------------- prefixes and confinement


def starts_raw(path: Column, prefix: str) -> Column:
    """Enrichment: any string prefix."""
    return path.startswith(prefix)


def within(rel_path: Column, prefix: str) -> Column:
    """Deletion: the path itself or what lies below it, by whole components."""
    return F.lit(True) if not prefix else (rel_path == prefix) | rel_path.startswith(prefix.rstrip("/") + "/")


def in_scope(rel_path: Column, scope: str, recursive: bool) -> Column:
    """Reconciliation: files below the scope, or directly in it."""
    base = scope.rstrip("/") + "/" if scope else ""
    below = rel_path.startswith(base)
    return below if recursive else below & (F.instr(F.substr(rel_path, F.lit(len(base) + 1)), F.lit("/")) == 0)


class OutsideRoots(PermissionError):
    pass


def resolve(roots: dict[str, str], requested: str) -> tuple[str, str]:
    """(root name, real path) of a requested absolute path that lies in one of the roots."""
    if not os.path.isabs(requested):
        raise ValueError(f"{requested}: an absolute path is needed")
    real = os.path.realpath(requested)
    for name, base in sorted(roots.items(), key=lambda r: -len(r[1])):
        base = os.path.realpath(base)
        if real == base or real.startswith(base.rstrip("/") + "/"):
            return name, real
    raise OutsideRoots(f"{requested}: not in any root")


def split_prefix(roots: dict[str, str], prefix: str) -> tuple[str, str]:
    """(root name, relative prefix) of a deletion prefix: absolute, without "..", not a whole root."""
    if not prefix.startswith("/"):
        raise ValueError(f"{prefix}: an absolute path is needed")
    if ".." in prefix.split("/"):
        raise ValueError(f"{prefix}: '..' is not allowed")
    path = "/" + "/".join(p for p in prefix.split("/") if p and p != ".")
    for name, base in sorted(roots.items(), key=lambda r: -len(r[1])):
        base = base.rstrip("/")
        if path == base:
            raise ValueError(f"{prefix}: a whole root cannot be deleted")
        if path.startswith(base + "/"):
            return name, path[len(base) + 1 :]
    raise OutsideRoots(f"{prefix}: not in any root")
