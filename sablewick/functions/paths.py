"""Path predicates: extensions, ignore patterns, languages.

One predicate serves indexing and syncing alike.  Patterns compile on the driver
into a few regular expressions; a path is ignored if it, one of its ancestors
or (for patterns without a slash) one of its segments matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablewick.functions import values


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows; empty for dot files and names without a dot."""
    return F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(values.OTHER_LANGUAGE))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression without anchors: ``*`` is any text (slashes too), all else is literal."""
    return ".*".join(re.escape(part).replace("/", "/") for part in pattern.split("*"))


def parse_ignore_file(text: str) -> list[str]:
    """Lines trimmed, without empty ones and comments; a leading ``!`` has no meaning."""
    lines = (line.strip() for line in text.split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def merge_patterns(*lists: Iterable[str]) -> list[str]:
    """Union in order of first appearance."""
    return list(dict.fromkeys(p for some in lists for p in some))


def merge_extensions(*lists: Iterable[str]) -> list[str]:
    """Union in order; entries are trimmed and get a leading dot."""
    trimmed = (e.strip() for some in lists for e in some)
    return list(dict.fromkeys(e if e.startswith(".") else f".{e}" for e in trimmed if e))


def extensions_from_env(value: str | None) -> list[str]:
    return merge_extensions((value or "").split(","))


def ignore_regex(patterns: Iterable[str]) -> str:
    """One expression that finds an ignored path, or ``(?!)`` (never) for no pattern.

    * ``name/``: any segment, and so everything below it;
    * a pattern with a slash: the relative path or one of its ancestors;
    * otherwise: any segment of the path.
    """
    whole, segment = [], []
    for raw in dict.fromkeys(patterns):
        pattern = raw.strip("/") if raw.endswith("/") or raw.startswith("/") else raw
        if not pattern:
            continue
        (whole if "/" in pattern else segment).append(glob_in_segment(pattern) if "/" not in pattern else glob_regex(pattern))
    parts = []
    if segment:
        parts.append(f"(?:^|/)(?:{'|'.join(segment)})(?:/|$)")
    if whole:
        parts.append(f"^(?:{'|'.join(whole)})(?:/|$)")
    return "|".join(parts) or "(?!)"


def glob_in_segment(pattern: str) -> str:
    """A glob within one path segment."""
    return "[^/]*".join(re.escape(part) for part in pattern.split("*"))


def ignored(path: Column, patterns: Iterable[str] = values.IGNORE_PATTERNS) -> Column:
    return path.rlike(ignore_regex(patterns))


def hidden(path: Column) -> Column:
    """Whether any segment begins with a dot."""
    return path.rlike(r"(?:^|/)\.")


def indexable(path: Column, extensions: Iterable[str] = values.EXTENSIONS, patterns: Iterable[str] = values.IGNORE_PATTERNS, skip_hidden: bool = False) -> Column:
    wanted = extension(path).isin(list(extensions)) & ~ignored(path, patterns)
    return wanted & ~hidden(path) if skip_hidden else wanted


def check_extension_filter(extensions: Iterable[object]) -> list[str]:
    """Validated extensions of a search filter; raises for anything else."""
    out, wrong = [], []
    for e in extensions:
        text = e.strip() if isinstance(e, str) else ""
        (out if text.startswith(".") and len(text) > 1 and not re.search(r"\s", text) else wrong).append(text or repr(e))
    if wrong:
        raise ValueError(f"invalid file extensions: {wrong}; each must be a string like '.ts'")
    return out


def is_test_file(path: Column) -> Column:
    """Whether the words of a path (cut at space, ``_``, ``/``, ``.``) include test, tests or testing."""
    return F.arrays_overlap(F.split(F.lower(path), "[ _/.]"), F.array(*[F.lit(w) for w in values.TEST_WORDS]))
