"""Splitters: one row per file becomes one row per chunk.

Line packing and overlap are expressed on columns (a fold, and a lagged window
per file); splitting by syntax or by characters runs in Arrow batches through a
table function.  Lengths are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewick.functions import text as text_
from sablewick.functions import values
from sablewick.operators.syntax import nodes


@dataclass
class Chunk:
    content: str
    start_line: int
    end_line: int
    node_type: str = ""


# ---------------------------------------------------------------- lines, on columns


def line_starts(lines: str, size: int) -> Column:
    """Greedy packing of a column of lines: the numbers, from 0, of those that begin a chunk.

    A chunk closes when the next line would take it past ``size`` (each line
    counts with its line break); a single longer line stays whole.  The fold
    carries numbers and no text.
    """
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("n"), F.lit(0).alias("line"))

    def step(s: Column, line: Column) -> Column:
        n = F.length(line) + 1
        new = (s["line"] == 0) | (s["n"] + n > size)
        return F.struct(
            F.when(new, F.concat(s["begins"], F.array(s["line"]))).otherwise(s["begins"]).alias("begins"),
            F.when(new, n).otherwise(s["n"] + n).cast("int").alias("n"),
            (s["line"] + 1).alias("line"),
        )

    return F.aggregate(lines, start, step, lambda s: s["begins"])


def line_chunks(files: DataFrame, size: int = values.LINE_CHUNK, *, path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    """(relative_path, pos, content, start_line, end_line) of greedily packed lines."""
    rows = files.select(path_col, text_.lines(F.coalesce(F.col(text_col), F.lit(""))).alias("__lines"))
    rows = rows.select(path_col, "__lines", line_starts("__lines", size).alias("__begins"))
    last = F.size("__begins") - 1
    chunk = F.transform(
        F.col("__begins"),
        lambda a, i: F.struct(
            F.array_join(F.slice("__lines", a + 1, F.when(i == last, F.size("__lines")).otherwise(F.get("__begins", i + 1)) - a), "\n").alias("content"),
            (a + 1).alias("start_line"),
            F.when(i == last, F.size("__lines")).otherwise(F.get("__begins", i + 1)).alias("end_line"),
        ),
    )
    return rows.select(path_col, F.posexplode(chunk).alias("pos", "c")).select(path_col, "pos", "c.*")


def with_overlap(chunks: DataFrame, overlap: int = values.SYNTAX_OVERLAP, *, path_col: str = "relative_path") -> DataFrame:
    """Each chunk but a file's first begins with the last ``overlap`` characters of the one before."""
    if overlap <= 0:
        return chunks
    before = F.lag("content").over(Window.partitionBy(path_col).orderBy("pos"))
    tail = F.when(F.length(before) <= overlap, before).otherwise(F.substring(before, -overlap, overlap))
    return (
        chunks.withColumn("__tail", tail)
        .withColumn("content", F.when(F.col("__tail").isNull(), F.col("content")).otherwise(F.concat("__tail", F.lit("\n"), "content")))
        .withColumn("start_line", F.when(F.col("__tail").isNull(), F.col("start_line")).otherwise(F.greatest(F.lit(1), F.col("start_line") - text_.line_count(F.col("__tail")))))
        .drop("__tail")
    )


# ---------------------------------------------------------------- one text


def pack(text: str, size: int, first_line: int = 1) -> list[Chunk]:
    """Greedy line packing of one text; each line counts with its line break."""
    out: list[Chunk] = []
    held: list[str] = []
    total, start = 0, first_line
    for k, line in enumerate(text.split("\n")):
        n = len(line) + 1
        if held and total + n > size:
            out.append(Chunk("\n".join(held), start, first_line + k - 1))
            held, total, start = [], 0, first_line + k
        held.append(line)
        total += n
    out.append(Chunk("\n".join(held), start, first_line + text.count("\n")))
    return out


def pack_large(text: str, size: int, first_line: int = 1) -> list[Chunk]:
    """Line packing of a chunk that is too large: the last line counts without a line break, pieces are trimmed, blank ones go."""
    lines = text.split("\n")
    out: list[Chunk] = []
    held, total, start = [], 0, 0

    def close(end: int) -> None:
        body = "\n".join(held).strip()
        if body:
            out.append(Chunk(body, first_line + start, first_line + end - 1))

    for k, line in enumerate(lines):
        n = len(line) + (k < len(lines) - 1)
        if total and total + n > size:
            close(k)
            held, total, start = [], 0, k
        held.append(line)
        total += n
    close(len(lines))
    return out


def split_lines(text: str, size: int = values.LINE_CHUNK, overlap: int = values.LINE_OVERLAP, least: int = values.LINE_LEAST) -> list[Chunk]:
    """Line splitter with overlapping lines: about ``overlap`` characters of whole lines repeat."""
    lines, out, begin = text.split("\n"), [], 0
    while begin < len(lines):
        end, total = begin, 0
        while end < len(lines) and (end == begin or total + len(lines[end]) + 1 <= size):
            total += len(lines[end]) + 1
            end += 1
        out.append(Chunk("\n".join(lines[begin:end]), begin + 1, end))
        if end == len(lines):
            break
        mean = total / (end - begin)
        repeat = min(int(overlap // mean) if mean else 0, end - begin - 1)
        begin = end - repeat
    return [c for c in out if len(c.content.strip()) > least]


#: Separators from coarse to fine, tried in order; words that begin a definition or a statement in each language's grammar.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
KEYWORDS = {
    "js": ("function", "const", "let", "var", "class", "if", "for", "while", "switch", "export"),
    "python": ("class", "def", "async def", "\tdef"),
    "java": ("class", "public", "protected", "private", "static", "if", "for", "while", "switch"),
    "cpp": ("class", "void", "int", "float", "double", "if", "for", "while", "switch"),
    "go": ("func", "var", "const", "type", "if", "for", "switch"),
    "rust": ("fn", "const", "let", "impl", "struct", "if", "while", "for", "loop", "match"),
    "php": ("function", "class", "if", "foreach", "while", "do", "switch"),
    "ruby": ("def", "class", "module", "if", "unless", "while", "for", "begin", "rescue"),
    "swift": ("func", "class", "struct", "enum", "if", "for", "while", "switch"),
    "scala": ("class", "object", "def", "val", "var", "if", "for", "while", "match"),
    "html": ("<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<table", "<ul"),
    "markdown": ("# ", "## ", "### ", "#### ", "```", "---"),
    "latex": ("\\chapter{", "\\section{", "\\subsection{", "\\begin{"),
    "sol": ("contract", "interface", "library", "function", "event", "modifier", "if", "for", "while"),
}


def separators(language: str | None) -> list[str]:
    name = values.SEPARATOR_ALIASES.get((language or "").lower(), (language or "").lower())
    # A word ends with a blank, so that ``if`` doesn't cut before ``iffy``.
    return [f"\n{w} " if w[-1].isalnum() and w[0] != "<" else f"\n{w}" for w in KEYWORDS.get(name, ())] + list(PLAIN_SEPARATORS)


def _packed(run: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring pieces joined up to ``size``; the next chunk begins with as many whole pieces as ``overlap`` and ``size`` allow."""
    first = 0
    for k, (begin, end) in enumerate(run):
        if k > first and end - run[first][0] > size:
            yield run[first][0], begin
            while first < k and (begin - run[first][0] > overlap or end - run[first][0] > size):
                first += 1
    if run:
        yield run[first][0], run[-1][1]


def _char_spans(text: str, begin: int, end: int, seps: list[str], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of a text's chunks, by the first separator that occurs; pieces that are too long by the next ones, on their own.

    A separator stays at the head of what follows, and cuts wherever it occurs,
    even within its own last occurrence.
    """
    at = next((k for k, sep in enumerate(seps) if not sep or text.find(sep, begin, end) >= 0), None)
    if at is None:
        yield begin, end
        return
    if not seps[at]:  # single characters: windows
        step = size - min(overlap, size - 1)
        while end - begin > size:
            yield begin, begin + size
            begin += step
        yield begin, end
        return
    cuts = [begin]
    cut = text.find(seps[at], begin + 1, end)
    while cut >= 0:
        cuts.append(cut)
        cut = text.find(seps[at], cut + 1, end)
    run: list[tuple[int, int]] = []
    for piece in zip(cuts, [*cuts[1:], end]):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _packed(run, size, overlap)
        run = []
        yield from _char_spans(text, *piece, seps[at + 1 :], size, overlap)
    yield from _packed(run, size, overlap)


def split_chars(text: str, language: str | None = None, size: int = values.CHAR_CHUNK, overlap: int = values.CHAR_OVERLAP) -> list[Chunk]:
    """Recursive character splitter: coarse separators first; trimmed chunks with their places, however often they are repeated."""
    breaks, out = [m.start() for m in re.finditer("\n", text)], []
    for begin, end in _char_spans(text, 0, len(text), separators(language), size, overlap):
        body = text[begin:end]
        begin += len(body) - len(body.lstrip())
        body = body.strip()
        if body:
            out.append(Chunk(body, bisect_left(breaks, begin) + 1, bisect_left(breaks, begin + len(body)) + 1))
    return out


# ---------------------------------------------------------------- syntax

def syntax_language(language: str | None) -> str | None:
    """The syntax splitter's name for a language, or None if it splits that one by characters."""
    name = (language or "").lower()
    name = values.SYNTAX_ALIASES.get(name, name)
    return name if name in values.SYNTAX_LANGUAGES else None


def split_syntax(code: str, language: str | None, size: int = values.SYNTAX_CHUNK, overlap: int = values.SYNTAX_OVERLAP, gaps: bool = False) -> list[Chunk]:
    """Definitions as chunks, nested ones again on their own; the whole file if there is none.

    A chunk is the text of its node and nothing before or after it on the line.
    Too large chunks are packed by lines.  With ``gaps`` chunks are whole lines,
    the lines between definitions are chunks too, and neighbours don't overlap.
    Other languages go to the character splitter.
    """
    name = syntax_language(language)
    if name is None:
        return split_chars(code, language, size, overlap)
    breaks = [m.start() for m in re.finditer("\n", code)]
    found = [Chunk(code[a:b], bisect_left(breaks, a) + 1, bisect_left(breaks, b) + 1, kind) for a, b, kind in nodes(code, name)]
    if gaps and found:
        lines, whole, covered = code.split("\n"), [], 0
        for c in found:
            if c.start_line > covered + 1:
                whole.append(Chunk("\n".join(lines[covered : c.start_line - 1]), covered + 1, c.start_line - 1, "gap"))
            whole.append(Chunk("\n".join(lines[c.start_line - 1 : c.end_line]), c.start_line, c.end_line, c.node_type))
            covered = max(covered, c.end_line)
        if covered < len(lines):
            whole.append(Chunk("\n".join(lines[covered:]), covered + 1, len(lines), "gap"))
        found = whole
    found = [c for c in found if c.content.strip()] or [Chunk(code, 1, len(breaks) + 1, "file")]
    out: list[Chunk] = []
    for c in found:
        if len(c.content) <= size:
            out.append(c)
        elif gaps:
            out += [Chunk(p.content, c.start_line + p.start_line - 1, c.start_line + p.end_line - 1, c.node_type) for p in split_chars(c.content, language, size, overlap)]
        else:
            out += [Chunk(p.content, p.start_line, p.end_line, c.node_type) for p in pack_large(c.content, size, c.start_line)]
    return out if gaps else overlapped(out, overlap)


def overlapped(chunks: list[Chunk], overlap: int) -> list[Chunk]:
    """Each chunk but the first begins with the end of the one before (before its own overlap)."""
    if overlap <= 0:
        return chunks
    out = chunks[:1]
    for before, c in zip(chunks, chunks[1:]):
        tail = before.content[-overlap:]
        out.append(Chunk(f"{tail}\n{c.content}", max(1, c.start_line - tail.count("\n") - 1), c.end_line, c.node_type))
    return out


# ---------------------------------------------------------------- files to chunks

KINDS = ("ast", "langchain", "lines")
CHUNKS = "relative_path string, pos int, content string, start_line long, end_line long, language string"


@dataclass(frozen=True)
class Splitter:
    """Which splitter, and its sizes."""

    kind: str = "ast"
    size: int | None = None
    overlap: int | None = None
    gaps: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown splitter {self.kind!r}; known: {', '.join(KINDS)}")

    def split(self, text: str, language: str | None) -> list[Chunk]:
        sizes = {"ast": (values.SYNTAX_CHUNK, values.SYNTAX_OVERLAP), "langchain": (values.CHAR_CHUNK, values.CHAR_OVERLAP), "lines": (values.LINE_CHUNK, values.LINE_OVERLAP)}[self.kind]
        size, overlap = self.size or sizes[0], sizes[1] if self.overlap is None else self.overlap
        if self.kind == "ast":
            return split_syntax(text, language, size, overlap, self.gaps)
        return split_chars(text, language, size, overlap) if self.kind == "langchain" else split_lines(text, size, overlap)

    def info(self) -> dict:
        return {"type": self.kind, "has_builtin_fallback": self.kind == "ast", "supported_languages": list(values.SYNTAX_LANGUAGES if self.kind == "ast" else values.SEPARATOR_LANGUAGES)}

    def strategy(self, language: str) -> dict:
        by_syntax = self.kind == "ast" and syntax_language(language) is not None
        return {"strategy": "ast" if by_syntax else "langchain", "reason": "a scanner for the language" if by_syntax else "by characters"}

    def chunks(self, files: DataFrame) -> DataFrame:
        """Chunks of files (relative_path, content, language), in Arrow batches and without a shuffle."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(CHUNKS)
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, text, language in zip(*(c.to_pylist() for c in batch.columns)):
                    # A chunk that is there twice would get the same id twice.
                    found = list({(c.start_line, c.end_line, c.content): c for c in self.split(text or "", language)}.values())
                    if found:
                        columns = [[path] * len(found), list(range(len(found))), [c.content for c in found], [c.start_line for c in found], [c.end_line for c in found], [language or "unknown"] * len(found)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return files.select("relative_path", "content", "language").mapInArrow(run, schema)


def large_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Files with very many chunks or characters: (relative_path, n_chunks, n_chars)."""
    n = chunks.groupBy("relative_path").agg(F.count("*").alias("n_chunks"))
    return files.select("relative_path", F.length("content").alias("n_chars")).join(n, "relative_path").filter((F.col("n_chunks") > values.LARGE_FILE_CHUNKS) | (F.col("n_chars") > values.LARGE_FILE_CHARS))


def capped(chunks: DataFrame, cap: int = values.CHUNK_CAP) -> tuple[DataFrame, str]:
    """At most ``cap`` chunks in a fixed order, and ``completed`` or ``limit_reached``.

    Only keys are ranked; the chunks themselves stay where they are.  ``chunks``
    is read twice, so it should be a written table.
    """
    keys = chunks.select("relative_path", "pos")
    if keys.limit(cap + 1).count() <= cap:
        return chunks, "completed"
    first = keys.orderBy("relative_path", "pos").limit(cap).select(F.col("relative_path").alias("__path"), F.col("pos").alias("__pos"))
    return chunks.join(first, (F.col("relative_path") == F.col("__path")) & (F.col("pos") == F.col("__pos")), "left_semi"), "limit_reached"
