"""Text expressions.  Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"
_SPACES = r"[\s\x{FEFF}\x{A0}]+"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{_SPACES}|{_SPACES}$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def tokens(text: Column) -> Column:
    """The analyser: lower-cased runs of a-z, 0-9 and ``_``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def match_bucket(score: Column) -> Column:
    percent = F.round(score * 100)
    return F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")


def line_window(text: Column, offset: int | None, limit: int | None) -> Column:
    """Lines ``offset`` .. ``offset + limit``; the whole text unless both are given."""
    if offset is None or limit is None:
        return text
    return F.array_join(F.slice(lines(text), offset + 1, limit), "\n")


def first_lines(text: Column, most: int = 30) -> Column:
    """At most ``most`` lines, then a note of how many follow."""
    n = F.size(lines(text))
    head = F.array_join(F.slice(lines(text), 1, most), "\n")
    return F.when(n > most, F.concat(head, F.lit("\n... ("), (n - most).cast("string"), F.lit(" more lines)"))).otherwise(text)


def start_line(whole: Column, part: Column) -> Column:
    """The line in which ``part`` first occurs in ``whole``; 1 if it does not."""
    at = F.call_function("instr", whole, part)
    return F.when(at > 0, F.size(F.split(F.substring(whole, F.lit(1), at - 1), "\n", -1))).otherwise(1)


def line_count(text: Column) -> Column:
    return F.size(lines(text))
