"""Paths and URLs as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension, case-sensitive (fixed values).
LANGUAGES = {
    ".cpp": "C++", ".hpp": "C++", ".h": "C++", ".c": "C", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript",
    ".java": "Java", ".go": "Go", ".rs": "Rust", ".md": "Markdown", ".txt": "Text",
}


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the file name; none for names that only begin with a dot, and for dots alone."""
    name = filename(path)
    return F.when(name.isin(".", ".."), "").otherwise(F.regexp_extract(name, r"\A.+?(\.[^.]*)\z", 1))


def stem(path: Column) -> Column:
    name = filename(path)
    return F.left(name, F.length(name) - F.length(extension(path)))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(.*?)/*[^/]*\z", 1)


def standardize(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("Other"))


def is_excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern holds: ``*x*`` contains, ``*x`` ends, ``x*`` begins, ``x`` is the path or its file name, ``*`` all.

    Stars in the middle are plain characters.
    """
    out = F.lit(False)
    for p in (p.replace("\\", "/") for p in patterns):
        if p == "*":
            out = F.lit(True)
        elif p.startswith("*") and p.endswith("*") and p[1:-1]:
            out = out | F.contains(path, F.lit(p[1:-1]))
        elif p.startswith("*") and not p.endswith("*"):
            out = out | F.endswith(path, F.lit(p[1:]))
        elif p.endswith("*") and not p.startswith("*"):
            out = out | F.startswith(path, F.lit(p[:-1]))
        elif p and not p.startswith("*"):
            out = out | (path == p) | (filename(path) == p)
    return out


def excluded(path: str, patterns: Sequence[str]) -> bool:
    """As ``is_excluded``, of one path, for folders that are not even to be listed."""
    for p in (p.replace("\\", "/") for p in patterns):
        begins, ends = p.startswith("*"), p.endswith("*")
        core = p[begins : len(p) - ends]
        if p == "*" or begins and ends and core and core in path or begins and not ends and path.endswith(core) or ends and not begins and path.startswith(core):
            return True
        if p and not begins and not ends and p in (path, path.rsplit("/", 1)[-1]):
            return True
    return False


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether the path ends in one of ``extensions``, case-sensitive."""
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(path, F.lit(e))
    return out


def strip_query(url: Column) -> Column:
    """The URL up to its first ? or #."""
    return F.regexp_replace(url, r"(?s)[?#].*", "")


def url_parts(url: Column) -> Column:
    """struct<scheme, host, path>; the path is empty where the URL has none."""
    pattern = r"\A([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(.*)\z"
    return F.struct(*[F.regexp_extract(url, pattern, i + 1).alias(n) for i, n in enumerate(("scheme", "host", "path"))])


def strip_common_prefix(paths: Column) -> Column:
    """An array of paths without the leading folders that all share; one segment stays at least.

    The common prefix of all is that of the least and the greatest path.
    """
    parts = F.transform(paths, lambda p: F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"))
    low, high = F.array_min(parts), F.array_max(parts)
    shortest = F.array_min(F.transform(parts, lambda p: F.size(p)))
    differs = F.filter(F.sequence(F.lit(1), shortest), lambda i: F.element_at(low, i) != F.element_at(high, i))
    shared = F.coalesce(F.array_min(differs) - 1, shortest)
    cut = F.when(shared == shortest, shared - 1).otherwise(shared)
    return F.when(cut <= 0, paths).otherwise(F.transform(parts, lambda p: F.array_join(F.slice(p, cut + 1, F.size(p)), "/")))
