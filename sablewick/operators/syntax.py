"""Definitions in source code: where the nodes begin and end that files are cut at.

A file is read once into tokens, in which strings, comments, template literals,
regular expressions, lifetimes and preprocessor lines hide nothing; a stack pairs
the brackets.  Each bracket's content is then read once as a list of statements,
members or expressions, and a statement's head says whether it is a definition.
Both steps are linear, also where brackets stay open: those end with what is
around them, and what they belong to is no node.  Python is read by logical lines and a stack of indents.

Which nodes count in which language is fixed (``NODES``); a language without any,
or a file in which none is found, is one chunk.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The nodes that become chunks, by language.
NODES = {
    "javascript": ("function_declaration", "arrow_function", "class_declaration", "method_definition", "export_statement"),
    "typescript": ("function_declaration", "arrow_function", "class_declaration", "method_definition", "export_statement", "interface_declaration", "type_alias_declaration"),
    "python": ("function_definition", "class_definition", "decorated_definition"),
    "java": ("method_declaration", "class_declaration", "interface_declaration", "constructor_declaration"),
    "cpp": ("function_definition", "class_specifier", "namespace_definition", "declaration"),
    "go": ("function_declaration", "method_declaration", "type_declaration", "var_declaration", "const_declaration"),
    "rust": ("function_item", "impl_item", "struct_item", "enum_item", "trait_item", "mod_item"),
    "csharp": ("method_declaration", "class_declaration", "interface_declaration", "struct_declaration", "enum_declaration"),
    "scala": (),
}

TEXT = r'"(?:\\[\s\S]|[^"\\\n])*"?'
LETTER = r"'(?:\\[^\n']+|[^\\'\n])'"
PLAIN = r"|(?P<word>[^\W\d][\w$]*|[$@][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|\+\+|--|[=!<>]=|&&|\|\||[^\s\w])"
COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
LINES = r"(?m:^[ \t]*\#(?:\\\n|[^\n])*)"
HIDDEN = {
    "javascript": rf"(?P<skip>{COMMENT})|(?P<text>{TEXT}|'(?:\\[\s\S]|[^'\\\n])*'?)",
    "java": rf'(?P<skip>{COMMENT})|(?P<text>"""[\s\S]*?(?:(?<!\\)"""|\Z)|{TEXT}|{LETTER})',
    "cpp": rf'(?P<skip>{COMMENT}|{LINES})|(?P<text>(?:u8|[uUL])?R"(?P<fence>[^()\s\\]*)\([\s\S]*?(?:\)(?P=fence)"|\Z)|(?:u8|[uUL])?{TEXT}|[uUL]?{LETTER})',
    "go": rf"(?P<skip>{COMMENT})|(?P<text>`[^`]*`?|{TEXT}|{LETTER})",
    "rust": rf'(?P<skip>//[^\n]*|(?P<nested>/\*))|(?P<text>b?r(?P<fence>\#*)"[\s\S]*?(?:"(?P=fence)|\Z)|b?{TEXT.replace("\\n", "")}|b?{LETTER}|\'\w+)',
    "csharp": rf'(?P<skip>{COMMENT}|{LINES})|(?P<text>\$*(?P<fence>"""+)[\s\S]*?(?:(?P=fence)|\Z)|(?:\$@|@\$|@)"(?:""|[^"])*"?|\$?{TEXT}|{LETTER})',
}
TOKENS = {name: re.compile(hidden + PLAIN.replace(r"\d[\w.]*", r"\d(?:[\w.]|'\d)*" if name == "cpp" else r"\d[\w.]*")) for name, hidden in HIDDEN.items()}
TOKENS["typescript"] = TOKENS["javascript"]
TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(?:`|\$\{|\\?\Z)")
PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "yield", "await"}
NESTED = re.compile(r"/\*|\*/")
#: Items of a statement that are looked at for what it defines.
HEAD = 64
CLOSES = {"{": "}", "(": ")", "[": "]"}


@dataclass
class Tokens:
    """What a file's text says, token by token, without what is hidden in it."""

    text: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)  # first on its line
    match: list[int] = field(default_factory=list)  # of an opening bracket, the index of its end

    def add(self, text: str, start: int, end: int, kind: str, fresh: bool) -> None:
        self.text.append(text), self.start.append(start), self.end.append(end), self.kind.append(kind), self.fresh.append(fresh), self.match.append(-1)


def tokens(code: str, language: str) -> Tokens:
    out, pattern, at, seen = Tokens(), TOKENS[language], 0, 0
    scripted = language in ("javascript", "typescript")
    holes: list[int] = []  # template literals: open braces when their hole began
    open_braces: list[int] = []
    depth = 0

    def put(text: str, start: int, end: int, kind: str) -> None:
        nonlocal seen
        out.add(text, start, end, kind, "\n" in code[seen:start] if start > seen else not out.text)
        seen = end

    def template(start: int) -> int:
        nonlocal depth
        m = TEMPLATE.match(code, start)
        put("`", start, m.end(), "text")
        if m.group().endswith("${"):
            depth += 1
            holes.append(depth)
            put("{", m.end() - 1, m.end(), "mark")
        return m.end()

    while at < len(code):
        m = pattern.search(code, at)
        if not m:
            break
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "fence":
            kind = "text"
        if kind in ("skip", "nested"):
            if kind == "nested" or language == "rust" and m["skip"].startswith("/*"):
                level = 1
                while level:
                    n = NESTED.search(code, at)
                    if not n:
                        at = len(code)
                        break
                    level, at = level + (1 if n.group() == "/*" else -1), n.end()
            continue
        text = m.group()
        if scripted and text == "`":
            at = template(start + 1)
            continue
        if scripted and text == "/":
            last = out.text[-1] if out.text else ""
            value = out.text and (out.kind[-1] in ("number", "text") or out.kind[-1] == "word" and last not in BEFORE_PATTERN or last in (")", "]", "}"))
            literal = None if value else PATTERN.match(code, start)
            if literal:
                put("/", start, literal.end(), "text")
                at = literal.end()
                continue
        if kind == "mark" and text == "{":
            depth += 1
        put(text, start, at, kind)
        if kind == "mark" and text == "}":
            if holes and holes[-1] == depth:
                holes.pop()
                depth -= 1
                at = template(at)
                continue
            depth = max(0, depth - 1)
    # Pairs of brackets; one that isn't closed ends where what is around it ends.
    stack: list[int] = []
    waiting = {"}": 0, ")": 0, "]": 0}
    for i, text in enumerate(out.text):
        if out.kind[i] != "mark":
            continue
        if text in CLOSES:
            stack.append(i)
            waiting[CLOSES[text]] += 1
        elif text in waiting and waiting[text]:
            while True:
                opened = stack.pop()
                closer = CLOSES[out.text[opened]]
                waiting[closer] -= 1
                out.match[opened] = i if closer == text else i - 1
                if closer == text:
                    break
    for opened in stack:
        out.match[opened] = len(out.text) - 1
    return out


MODIFIERS = {"public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "async", "override", "virtual", "partial", "readonly", "synchronized", "native", "strictfp", "default", "unsafe", "extern", "new", "declare", "transient", "volatile", "required", "file", "const", "pub", "crate", "non"}
CONTROL = {"if", "for", "while", "switch", "catch", "else", "do", "return", "try", "with", "finally", "throw", "foreach", "using", "lock", "case", "break", "continue", "goto", "new", "delete", "await", "yield", "synchronized", "match", "loop", "select", "defer", "go", "range", "import", "package", "assert", "fixed", "checked"}
ENDS_LINE = {")", "]", "}", "++", "--"}
GOES_ON = {".", ",", "?", ":", "=", "=>", "+", "-", "*", "/", "&", "|", "&&", "||", "<", ">", "==", "!=", "<=", ">=", "(", "[", "{", "%", "^", ")", "]", "}", "instanceof", "in", "of", "else", "catch", "finally", "while", "extends", "implements", "as", "satisfies"}


class Reader:
    """Nodes of one file in a language with braces."""

    def __init__(self, code: str, language: str):
        self.language, self.t, self.found = language, tokens(code, language), []
        self.scripted = language in ("javascript", "typescript")
        self.work: list[tuple[str, int, int]] = [("top", 0, len(self.t.text))]
        while self.work:
            self.read(*self.work.pop())

    def node(self, kind: str, first: int, last: int) -> None:
        if kind in NODES[self.language] and last >= first and not self.broken:
            self.found.append((self.t.start[first], self.t.end[last], kind))

    def inside(self, kind: str, opener: int) -> None:
        """Queue what a bracket holds."""
        last = self.t.match[opener]
        self.work.append((kind, opener + 1, last if self.closed(opener) else last + 1))

    def closed(self, opener: int) -> bool:
        last = self.t.match[opener]
        return last > opener and self.t.kind[last] == "mark" and self.t.text[last] == CLOSES[self.t.text[opener]]

    def read(self, kind: str, at: int, stop: int) -> None:
        """The items of one context: tokens, and brackets as their opening token."""
        t, items = self.t, []
        while at < stop:
            text, mark = t.text[at], t.kind[at] == "mark"
            if items and t.fresh[at] and self.breaks(kind, items, at):
                self.statement(kind, items)
                items = []
            items.append(at)
            if mark and text in CLOSES:
                at = min(t.match[at], stop - 1) + 1
                if text == "{" and kind in ("top", "class", "block") and self.closes(kind, items, at, stop):
                    self.statement(kind, items)
                    items = []
                continue
            at += 1
            if mark and (text == ";" or text == "," and kind in ("expr", "object")):
                self.statement(kind, items)
                items = []
            elif self.scripted and text == ":" and mark and kind == "block" and len(items) == 2 and t.text[items[0]] in ("default",):
                items = []
        if items:
            self.statement(kind, items)

    def last(self, item: int) -> int:
        """The index of an item's last token."""
        return max(item, self.t.match[item])

    def breaks(self, kind: str, items: list[int], at: int) -> bool:
        """Whether a statement ends at the line's end before this token."""
        t, before = self.t, self.last(items[-1])
        able = t.kind[before] != "mark" or t.text[before] in ENDS_LINE
        if self.language == "go":
            return kind in ("top", "block") and able
        if not self.scripted or kind not in ("top", "class", "block") or not able:
            return False
        if t.text[at] in GOES_ON and t.kind[at] != "text":
            return False
        return self.head(items)[0] not in ("if", "for", "while") or t.text[items[-1]] == "{"

    def head(self, items: list[int]) -> tuple[str, int]:
        """The first word that isn't a modifier, an annotation or an attribute, and its place among the items."""
        t, k = self.t, 0
        while k < len(items):
            text = t.text[items[k]]
            if text == "@" or t.kind[items[k]] == "word" and text.startswith("@") and self.language != "csharp":
                k += 2 if text == "@" else 1
                while k + 1 < len(items) and t.text[items[k]] == ".":
                    k += 2
                k += k < len(items) and t.text[items[k]] == "("
            elif text == "#" and self.language == "rust":
                k += 1 + (k + 1 < len(items) and t.text[items[k + 1]] == "!") + 1
            elif text == "[" and self.language == "csharp" or self.language == "cpp" and text == "[" and k == 0:
                k += 1
            elif text == "template" and self.language == "cpp":
                k = self.past_angles(items, k + 1)
            elif text in MODIFIERS and t.kind[items[k]] == "word" and not (self.language in ("cpp", "go") and text != "extern") and not (text == "const" and self.scripted):
                k += 1
                if text == "extern" and k < len(items) and t.kind[items[k]] == "text":
                    k += 1
                if text == "pub" and k < len(items) and t.text[items[k]] == "(":
                    k += 1
            else:
                return (text if t.kind[items[k]] == "word" else ""), k
        return "", len(items)

    def past_angles(self, items: list[int], k: int) -> int:
        """The place after a list in angle brackets that begins here, if one does."""
        t, depth, at = self.t, 0, k
        while at < len(items):
            text = t.text[items[at]]
            depth += (text == "<") - (text == ">")
            at += 1
            if not depth:
                return at if at > k + 1 or text == ">" else k
        return k

    def closes(self, kind: str, items: list[int], at: int, stop: int) -> bool:
        """Whether a statement ends with the braces it has just had."""
        t = self.t
        # A statement may hold any number of braces: its head and its end tell.
        items = items if len(items) <= HEAD + 4 else items[:HEAD] + items[-4:]
        word, k = self.head(items)
        texts = [t.text[i] for i in items]
        if len(items) == 1:
            return True
        before = texts[-2]
        if self.language == "cpp":
            if {"class", "struct", "union", "enum"} & set(texts[k : k + 1]) and "(" not in texts:
                return not (at < stop and t.text[at] != "}")
            return "=" not in texts[:-1] and before not in ("return", ",") and (before == ")" or "(" in texts or word in ("namespace", "extern", "do", "else", "try") or "extern" in texts)
        if self.language == "go":
            return False
        if self.language == "rust":
            return "=" not in texts[:-1] and word not in ("let", "return", "use", "const", "static") or word == "fn"
        if self.scripted:
            if before in (":", "|", "&") and at < stop and t.text[at] in ("{", "|", "&"):  # a type in braces
                return False
            if kind == "class":
                return "=" not in texts[:-1] and (before in (")", "(", "static", ">") or "(" in texts or "[" in texts)
            if texts[0] == "export" and "default" not in texts[:2]:
                word = next((x for x in texts[1:] if x not in MODIFIERS), "")
            elif texts[0] == "export":
                word = next((x for x in texts[2:] if x not in MODIFIERS), "")
            return word in ("function", "class", "interface", "enum", "namespace", "module", "if", "for", "while", "do", "else", "try", "catch", "finally", "switch", "with")
        body = not {"=", "->", "=>"} & set(texts[:-1]) and word not in ("return", "new", "throw") and "new" not in texts[k:]
        return body or word in ("if", "for", "while", "switch", "class", "do", "else", "try", "foreach")

    # ------------------------------------------------------------ statements

    def statement(self, kind: str, items: list[int]) -> None:
        self.broken = any(self.t.match[i] >= 0 and not self.closed(i) for i in items)
        if self.scripted:
            self.script(kind, items)
        else:
            getattr(self, self.language)(kind, items)

    def groups(self, items: list[int], body: int | None = None, kind: str = "block", others: str = "block") -> None:
        """Queue all brackets of a statement; ``body`` is the one with a kind of its own."""
        for i in items:
            if self.t.match[i] >= 0:
                self.inside(kind if i == body else others if self.t.text[i] == "{" else "expr", i)

    def braces(self, items: list[int]) -> int | None:
        return next((i for i in reversed(items) if self.t.text[i] == "{" and self.t.match[i] >= 0), None)

    def name_before(self, items: list[int], k: int, bracket: str = "(") -> int:
        """Where the first parameter list after place k is that follows a name; -1 if none does before ``=``."""
        t = self.t
        for n in range(max(k, 1), len(items)):
            if t.text[items[n]] in ("=", "=>") and t.kind[items[n]] == "mark":
                return -1
            if t.text[items[n]] == bracket and (t.kind[items[n - 1]] == "word" or t.text[items[n - 1]] in (">", "]")):
                return n
        return -1

    def java(self, kind: str, items: list[int]) -> None:
        t, (word, k) = self.t, self.head(items)
        body, last = self.braces(items), self.last(items[-1])
        if word in ("class", "interface", "enum", "record") or word == "" and k < len(items) and t.text[items[k]] == "@" and k + 1 < len(items) and t.text[items[k + 1]] == "interface":
            self.node({"class": "class_declaration", "interface": "interface_declaration"}.get(word, ""), items[0], last)
            return self.groups(items, body, "class")
        at = self.name_before(items, k) if kind == "class" else -1
        if at > 0 and word not in CONTROL:
            self.node("constructor_declaration" if at == k + 1 and body is not None else "method_declaration" if at > k + 1 else "", items[0], last)
            return self.groups(items, body, "block")
        self.values(kind, items)

    def values(self, kind: str, items: list[int]) -> None:
        """Brackets of a statement with values: bodies of anonymous classes hold members, others statements."""
        t = self.t
        texts = [t.text[i] for i in items]
        new = texts.index("new") if "new" in texts else len(texts)
        for n, i in enumerate(items):
            if t.match[i] >= 0:
                made = texts[n] == "{" and n and texts[n - 1] == "(" and new < n and not {"->", "=>"} & {texts[max(0, n - 2)]}
                self.inside("expr" if texts[n] != "{" else "class" if made and self.language == "java" or kind == "class" and n and texts[n - 1] != "=" and self.language == "java" and t.kind[items[n - 1]] == "word" else "block", i)

    def csharp(self, kind: str, items: list[int]) -> None:
        t, (word, k) = self.t, self.head(items)
        body, last = self.braces(items), self.last(items[-1])
        if word in ("class", "interface", "struct", "enum", "record", "namespace"):
            if not (word == "namespace" and body is None):
                self.node(f"{word}_declaration", items[0], last)
            return self.groups(items, body, "top" if word == "namespace" else "block" if word == "enum" else "class")
        at = self.name_before(items, k) if kind == "class" else -1
        if at > k + 1 and word not in CONTROL and word not in ("event", "delegate", "operator", "implicit", "explicit") and "operator" not in [t.text[i] for i in items[:at]]:
            self.node("method_declaration", items[0], last)
        self.groups(items, body, "block")

    def rust(self, kind: str, items: list[int]) -> None:
        t, (word, k) = self.t, self.head(items)
        body, last = self.braces(items), self.last(items[-1])
        first = 0
        while first < k and t.text[items[first]] == "#":
            first += 2 + (first + 1 < k and t.text[items[first + 1]] == "!")
        name = {"impl": "impl_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "mod": "mod_item", "fn": "function_item"}.get(word, "")
        if name and first < len(items) and not (word == "fn" and body is None):
            self.node(name, items[first], last)
        self.groups(items, body, "top" if word in ("impl", "trait", "mod", "extern") else "expr" if word in ("struct", "enum", "union") else "block")

    def go(self, kind: str, items: list[int]) -> None:
        t, word = self.t, self.t.text[items[0]]
        end = items[:-1] if t.text[items[-1]] == ";" and len(items) > 1 else items
        if kind in ("top", "block") and word in ("type", "var", "const"):
            self.node(f"{word}_declaration", items[0], self.last(end[-1]))
        elif kind == "top" and word == "func":
            self.node("method_declaration" if len(items) > 1 and t.text[items[1]] == "(" else "function_declaration", items[0], self.last(end[-1]))
        texts = [t.text[i] for i in items]
        called = kind == "top" and word == "func"
        func = texts.index("func") if "func" in texts else len(texts)
        for n, i in enumerate(items):
            if t.match[i] >= 0:
                body = texts[n] == "{" and (called or func < n or texts[0] in ("if", "for", "switch", "select", "else", "{") or n == 0)
                self.inside("block" if body else "expr", i)

    def cpp(self, kind: str, items: list[int]) -> None:
        t = self.t
        if len(items) >= 2 and t.text[items[0]] in ("public", "private", "protected") and t.text[items[1]] == ":":
            items = items[2:]
        while len(items) >= 2 and t.kind[items[0]] == "word" and t.text[items[0]] in ("public", "private", "protected", "signals", "slots"):
            items = items[1:]
        if not items:
            return
        word, k = self.head(items)
        texts = [t.text[i] for i in items]
        body, last = self.braces(items), self.last(items[-1])
        start = next((n for n in range(len(items)) if texts[n] != "template"), 0) if texts[0] != "template" else self.past_angles(items, 1)
        while start < len(items) and texts[start] == "template":
            start = self.past_angles(items, start + 1)
        if start >= len(items):
            return self.groups(items)
        if word == "namespace" or texts[start] == "inline" and "namespace" in texts[start : start + 2]:
            if body is not None:
                self.node("namespace_definition", items[start], last)
            return self.groups(items, body, "top")
        if "extern" in texts[:2] and body is not None and "(" not in texts:
            return self.groups(items, body, "top")
        if word in ("class", "struct", "union", "enum") and body is not None and "(" not in texts[: items.index(body)]:
            if word == "class":
                self.node("class_specifier", items[k], self.last(body))
            if items[-1] != body and self.last(items[-1]) != self.last(body) and len(items) - 1 - items.index(body) > 1:
                self.node("declaration", items[start], last)
            return self.groups(items, body, "class" if word != "enum" else "expr")
        at = self.name_before(items, start)
        if at > 0 and body is not None and items[-1] == body and word not in CONTROL and texts[start] not in CONTROL and "=" not in texts[start:at]:
            self.node("function_definition", items[start], last)
            return self.groups(items, body, "block")
        if texts[-1] == ";" and self.declares(items, start) and kind != "class" and kind != "object":
            self.node("declaration", items[start], last)
        if texts[0] == "for" and len(items) > 1 and texts[1] == "(":
            inner = items[1] + 1
            end = next((n for n in range(inner, t.match[items[1]]) if t.text[n] == ";"), -1)
            first = [n for n in range(inner, end + 1)]
            if first and self.declares(first, 0):
                self.node("declaration", first[0], end)
        if texts[0] in CONTROL and len(items) > 2 and body is None:  # what stands without braces after a head
            rest = [n for n in range(1, len(items)) if texts[n] == "("]
            if rest and rest[0] + 1 < len(items) and texts[0] in ("if", "for", "while") and texts[-1] == ";" and self.declares(items, rest[0] + 1):
                self.node("declaration", items[rest[0] + 1], last)
        if texts[0] in ("case", "default") and ":" in texts and texts[-1] == ";" and self.declares(items, texts.index(":") + 1):
            self.node("declaration", items[texts.index(":") + 1], last)
        self.groups(items, body, "block")

    def declares(self, items: list[int], k: int) -> bool:
        """Whether a type and a name begin here."""
        t = self.t
        texts = [t.text[i] for i in items]
        if k >= len(items) or texts[k] in CONTROL or texts[k] in ("typedef", "using", "template", "friend", "static_assert", "public", "private", "protected", "class", "struct", "union", "enum", "operator", "this", "sizeof", "co_return", "co_await"):
            return k < len(items) and texts[k] in ("class", "struct", "union", "enum") and len(items) - k > 3 and t.kind[items[k + 2]] == "word"
        words, n = 0, k
        while n < len(items):
            kind, text = t.kind[items[n]], texts[n]
            if kind == "word":
                words += 1
                n += 1
                if n < len(items) and texts[n] == "<":
                    past = self.past_angles(items, n)
                    if past == n:
                        return False
                    n = past
                while n + 1 < len(items) and texts[n] == "::" and t.kind[items[n + 1]] == "word":
                    n += 2
                    if n < len(items) and texts[n] == "<":
                        n = max(n + 1, self.past_angles(items, n))
            elif text in ("*", "&", "&&") and words:
                n += 1
            else:
                break
        return words >= 2 and n < len(items) and (texts[n] in ("=", ";", ",", "(", "[", "{", ":"))

    # ------------------------------------------------------------ scripts

    def script(self, kind: str, items: list[int]) -> None:
        t = self.t
        texts = [t.text[i] for i in items]
        last = self.last(items[-1])
        end = items[:-1] if texts[-1] in (";", ",") and len(items) > 1 and t.kind[items[-1]] == "mark" else items
        if kind in ("top", "block"):
            first = 0
            if texts[0] == "export" or "export" in texts and texts[0].startswith("@"):
                self.node("export_statement", items[0], last)
                first = texts.index("export") + 1
                first += first < len(items) and texts[first] == "default"
            _, k = self.head(items[first:])
            k += first
            word = texts[k] if k < len(items) else ""
            begin = first
            while begin < k and texts[begin] in ("declare", "default"):
                begin += 1
            if begin < len(items):
                stop = self.last(end[-1])
                named = k + 1 < len(items) and t.kind[items[k + 1]] == "word"
                if word == "function" and named and "{" in texts:
                    self.node("function_declaration", items[begin], stop)
                elif word == "class" and named and "abstract" not in texts[first:k]:
                    self.node("class_declaration", items[begin], stop)
                elif word == "interface" and named:
                    self.node("interface_declaration", items[begin], stop)
                elif word == "type" and named and "=" in texts:
                    self.node("type_alias_declaration", items[begin], last)
            if word in ("interface", "type") and k + 1 < len(items) and t.kind[items[k + 1]] == "word" and ("=" in texts or word == "interface"):
                return
            if word in ("enum", "import"):
                return
        elif kind in ("class", "object"):
            at = next((n for n, x in enumerate(texts) if x in ("(", "=", ":", "=>", "?", "<") and t.kind[items[n]] == "mark"), -1)
            if at > 0 and texts[at] == "<":
                at = self.past_angles(items, at)
            body = next((n for n in range(at + 1, len(items)) if texts[n] == "{"), -1) if 0 < at < len(items) and texts[at] == "(" else -1
            if body > 0 and "=>" not in texts[at:body] and "=" not in texts[at:body]:
                while body + 1 < len(items) and texts[body + 1] == "{":  # a type in braces, then the body
                    body += 1
                begin = 0
                while begin < len(items) and texts[begin].startswith("@"):
                    begin += 1 if len(texts[begin]) > 1 else 2
                    begin += begin < len(items) and texts[begin] == "("
                self.node("method_definition", items[begin], t.match[items[body]])
        self.arrows(kind, items, texts, end)
        at_class, at_extends = (texts.index(x) if x in texts else len(texts) for x in ("class", "extends"))
        for n, i in enumerate(items):
            if t.match[i] < 0:
                continue
            if texts[n] != "{":
                self.inside("expr", i)
                continue
            before = texts[n - 1] if n else ""
            if at_class < n and t.kind[items[at_class]] == "word" and (before not in (")", "=>", "(") or at_extends < n):
                self.inside("class", i)
            elif n == 0 and kind in ("expr", "object"):
                self.inside("object", i)
            elif before in ("=", ":", "return", ",", "?", "[", "default", "...", ".", "of", "in", "&&", "||", "??", "|") and before != "":
                self.inside("object", i)
            else:
                self.inside("block", i)

    def arrows(self, kind: str, items: list[int], texts: list[str], end: list[int]) -> None:
        t, waiting, past_equals = self.t, [], False
        typed = texts[0] in ("const", "let", "var") or texts[0] == "export" and len(texts) > 1 and texts[1] in ("const", "let", "var")
        for n, text in enumerate(texts):
            if t.kind[items[n]] != "mark":
                continue
            if text in (",", ";") and n:
                for first in waiting:
                    self.node("arrow_function", first, self.last(items[n - 1]))
                waiting, past_equals = [], False
            past_equals |= text == "="
            if text != "=>" or not n:
                continue
            first = n - 1
            if texts[first] != "(" and not (t.kind[items[first]] == "word" and (first == 0 or texts[first - 1] not in (":", ">", "|", "&", "."))):
                while first > 0 and texts[first] not in ("=", ",", "=>") and not (texts[first] == ":" and texts[first - 1] == "("):
                    first -= 1
                first -= texts[first] == ":"
                if texts[first] != "(":
                    continue
            elif texts[first] != "(" and first and texts[first - 1] == ":" and kind != "object":
                continue
            before = texts[first - 1] if first else ""
            if before == ":" and kind != "object" and "?" not in texts[:first] and not (typed and past_equals) and not (kind == "class" and past_equals):
                continue  # the type of a function
            if before == ">":
                depth = 0
                while first > 0:
                    first -= 1
                    depth += (texts[first] == ">") - (texts[first] == "<")
                    if not depth:
                        break
                before = texts[first - 1] if first else ""
            first -= before == "async"
            if n + 1 < len(items) and texts[n + 1] == "{":
                self.node("arrow_function", items[first], t.match[items[n + 1]])
            else:
                waiting.append(items[first])
        for first in waiting:
            self.node("arrow_function", first, self.last(end[-1]))


# ---------------------------------------------------------------- indents

PYTHON = re.compile(r"#[^\n]*|(?:[rRbBuUfF]{0,2})(?:'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'(?:\\[\s\S]|[^'\\\n])*'?|\"(?:\\[\s\S]|[^\"\\\n])*\"?)|\\\n|[()\[\]{}]|\n")
DEFINES = re.compile(r"(?:(async[ \t]+)?def|class)\b")


def logical_lines(code: str) -> list[tuple[int, int, int]]:
    """(indent, first character, end) of each logical line; blank ones and comments are left out."""
    out, depth, at, end = [], 0, 0, 0

    def close() -> None:
        body = code[at:end]
        if body.strip():
            lead = len(body) - len(body.lstrip())
            own = body[:lead].rpartition("\n")[2]
            out.append((len(own.expandtabs(8)), at + lead, at + len(body.rstrip())))

    for m in PYTHON.finditer(code):
        token = m.group()
        gap = code[end : m.start()]
        if token[0] == "#":
            if gap.strip():
                end = m.start()
                end -= len(code[at:end]) - len(code[at:end].rstrip())
            # What a comment hides isn't part of the line; the line goes on only within brackets.
            nl = code.find("\n", m.end())
            if not depth:
                close()
                at = end = m.end()
            continue
        if token in "([{":
            depth += 1
        elif token in ")]}":
            depth = max(0, depth - 1)
        if token == "\n" and not depth:
            end = m.start() if gap.strip() else end
            close()
            at = end = m.end()
        elif token == "\n":
            # An open bracket that a definition follows at the line's start was never closed.
            if DEFINES.match(code, m.end()):
                depth, end = 0, m.start()
                close()
                at = end = m.end()
        else:
            end = m.end()
    end = len(code)
    close()
    return out


def python_nodes(code: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    open_: list[tuple[int, int, str, int]] = []  # indent, start, kind, start of the decorators or -1
    last, decorated = 0, -1

    def leave(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, start, kind, before = open_.pop()
            found.append((start, last, kind))
            if before >= 0:
                found.append((before, last, "decorated_definition"))

    for indent, start, end in logical_lines(code):
        leave(indent)
        last = end
        if code[start] == "@":
            decorated = start if decorated < 0 else decorated
            continue
        m = DEFINES.match(code, start)
        if m:
            open_.append((indent, start, "class_definition" if m.group().startswith("class") else "function_definition", decorated))
        decorated = -1
    leave(-1)
    return found


def nodes(code: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all nodes that become chunks, outer ones before those within."""
    if not NODES[language]:
        return []
    found = python_nodes(code) if language == "python" else Reader(code, language).found
    return sorted(set(found), key=lambda x: (x[0], -x[1]))
