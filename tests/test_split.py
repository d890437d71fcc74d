"""Splitters: hand-derived cases and invariants."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sablewick.operators import split
from sablewick.operators.syntax import NODES, nodes


def spans(chunks):
    return [(c.content, c.start_line, c.end_line) for c in chunks]


def test_pack():
    assert spans(split.pack("aaaa\nbbbb\ncccc", 10, 5)) == [("aaaa\nbbbb", 5, 6), ("cccc", 7, 7)]
    assert spans(split.pack("a" * 50, 10)) == [("a" * 50, 1, 1)]


def test_overlap():
    chunks = [split.Chunk("abcdefgh", 1, 1), split.Chunk("xyz", 2, 2)]
    assert spans(split.overlapped(chunks, 5)) == [("abcdefgh", 1, 1), ("defgh\nxyz", 1, 2)]
    assert split.overlapped(chunks, 0) == chunks


def test_lines():
    assert spans(split.split_lines("aaaa\nbbbb\ncccc", 10, 4, 0)) == [("aaaa\nbbbb", 1, 2), ("cccc", 3, 3)]
    assert split.split_lines("tiny") == []


PY = "import os\n\n@wraps\ndef f():\n    return 1\n\nclass A:\n    def m(self):\n        pass\n\nx = 1\n"


def test_python_syntax():
    got = spans(split.split_syntax(PY, "python", 2500, 0))
    f, m = "def f():\n    return 1", "def m(self):\n        pass"
    assert got == [(f"@wraps\n{f}", 3, 5), (f, 4, 5), (f"class A:\n    {m}", 7, 9), (m, 8, 9)]
    assert spans(split.split_syntax("x = 1\n", "py", 2500, 0)) == [("x = 1\n", 1, 2)]
    assert split.split_syntax("def (:", "python")[0].content == "def (:"


def test_gaps_cover_everything():
    got = split.split_syntax(PY, "python", 2500, 0, gaps=True)
    seen = {n for c in got for n in range(c.start_line, c.end_line + 1)}
    assert {n for n, line in enumerate(PY.split("\n"), 1) if line.strip()} <= seen


@pytest.mark.parametrize(
    ("language", "code", "first"),
    [
        ("javascript", "const a = 1;\nfunction f(x) {\n  if (x) {\n    return '}';\n  }\n}\n", (2, 6)),
        ("typescript", "interface A {\n  x: number;\n}\n", (1, 3)),
        ("java", "public class A {\n  public int f() {\n    return 1;\n  }\n}\n", (1, 5)),
        ("go", "package a\n\nfunc f() {\n\treturn\n}\n", (3, 5)),
        ("rust", "pub fn f() {\n    g();\n}\n", (1, 3)),
        ("cpp", "int f(int a) {\n  return a;\n}\n", (1, 3)),
        ("csharp", "public class A\n{\n  public int F() { return 1; }\n}\n", (1, 4)),
        ("scala", "object A {\n  def f(): Int = {\n    1\n  }\n}\n", (1, 6)),  # no nodes of its own: the whole file
    ],
)
def test_brace_syntax(language, code, first):
    c = split.split_syntax(code, language, 2500, 0)[0]
    assert (c.start_line, c.end_line) == first


def test_names():
    assert split.syntax_language("C++") == "cpp" and split.syntax_language("ruby") is None
    assert split.Splitter("ast").strategy("python")["strategy"] == "ast" and split.Splitter("ast").strategy("ruby")["strategy"] == "langchain"
    assert "python" in split.Splitter().info()["supported_languages"]
    with pytest.raises(ValueError):
        split.Splitter("other")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 60), st.integers(0, 10))
def test_chars_keep_words_and_limits(text, size, overlap):
    chunks = split.split_chars(text, None, size, min(overlap, size - 1))
    assert all(len(c.content) <= size for c in chunks)
    assert "".join(text.split()) == "".join("".join(c.content.split()) for c in split.split_chars(text, None, size, 0))
    lines = text.split("\n")
    for c in chunks:
        assert 1 <= c.start_line <= c.end_line <= len(lines)


def test_on_files(spark):
    files = spark.createDataFrame([("a.py", PY, "python"), ("b.md", "x\n" * 2000, "text"), ("c.py", None, "python")], "relative_path string, content string, language string")
    rows = split.Splitter("ast", overlap=0).chunks(files).collect()
    assert {r["relative_path"] for r in rows} == {"a.py", "b.md", "c.py"} and all(r["start_line"] <= r["end_line"] for r in rows)
    got, status = split.capped(split.Splitter("lines").chunks(files), 2)
    assert status == "limit_reached" and got.count() == 2


def test_line_chunks_match_pack(spark):
    text = "\n".join("w" * (i * 7 % 40) for i in range(50))
    files = spark.createDataFrame([("a", text)], "relative_path string, content string")
    rows = split.line_chunks(files, 100).orderBy("pos").collect()
    assert [(r["content"], r["start_line"], r["end_line"]) for r in rows] == spans(split.pack(text, 100))


def test_pack_large():
    assert spans(split.pack_large("aaaa\nbbbb\ncccc", 10, 5)) == [("aaaa\nbbbb", 5, 6), ("cccc", 7, 7)]
    assert len(split.pack_large("aaaaaaaaa\nbbbbb\ncccc", 10)) == 2  # the last line counts without a line break
    code = "def f():\n" + "\n" * 30 + "    return 1"
    assert all(c.content.strip() for c in split.pack_large(code, 12)) and split.pack_large("\n" * 50, 10) == []
    assert spans(split.pack_large("a" * 50, 10)) == [("a" * 50, 1, 1)]


def test_separators_are_whole_words():
    assert "\nif " in split.separators("javascript") and "\nif" not in split.separators("javascript")
    assert "\n<div" in split.separators("html") and "\n## " in split.separators("markdown")


def test_repeated_chunks_come_once(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n", "python")], "relative_path string, content string, language string")
    rows = split.Splitter("ast", overlap=0).chunks(files).collect()
    assert len({(r["start_line"], r["content"]) for r in rows}) == len(rows)


# ---------------------------------------------------------------- nodes, derived by hand

CASES = [
    # A brace on its own line, an attribute, a property, an expression body; constructors are no nodes.
    ("csharp", "class A\n{\n    [Fact]\n    public int F(int x)\n    {\n        return x;\n    }\n    int P { get; set; }\n    string S() => \"}\";\n    A(int y) { }\n}\nenum E { A }\n",
     [("class_declaration", 1, 11), ("method_declaration", 3, 7), ("method_declaration", 9, 9), ("enum_declaration", 12, 12)]),
    # A lifetime isn't a character; heads without a body in a trait are no nodes; nested comments.
    ("rust", "#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nfn f<'a>(x: &'a str) -> char {\n  let c = '}';\n  c\n}\n/* /* fn x() {} */ fn y() {} */\ntrait T { fn a(&self); fn b(&self) { } }\nmod m;\n",
     [("struct_item", 2, 2), ("function_item", 3, 6), ("trait_item", 8, 8), ("function_item", 8, 8), ("mod_item", 9, 9)]),
    # Template literals with holes, regular expressions, arrows within arguments, methods of objects.
    ("javascript", "function f() {\n  const s = `a } ${g({a: 1})} }`;\n  return s;\n}\nexport default class A {\n  async m(a, {b}) {\n    return [1].map(z => z + 1);\n  }\n  h = () => {\n  }\n}\nconst o = { run() { return /}/.test('}') } };\nfoo(function () { function inner() {} })\n",
     [("function_declaration", 1, 4), ("export_statement", 5, 11), ("class_declaration", 5, 11), ("method_definition", 6, 8), ("arrow_function", 7, 7), ("arrow_function", 9, 10), ("method_definition", 12, 12), ("function_declaration", 13, 13)]),
    # Arguments on several lines, types of functions, abstract classes (whose methods alone are nodes), types in braces.
    ("typescript", "interface I {\n  a(x: number): void;\n}\ntype T = { a: (x: number) => void };\nabstract class C<T> {\n  async m(\n    a: string,\n    b: number,\n  ): Promise<void> {\n    return;\n  }\n  abstract n(): void;\n}\nconst f: (a: number) => void = (a: number): void => { };\nfunction g(): { a: number } {\n  return { a: 1 };\n}\n",
     [("interface_declaration", 1, 3), ("type_alias_declaration", 4, 4), ("method_definition", 6, 11), ("arrow_function", 14, 14), ("function_declaration", 15, 17)]),
    # Package-private and abstract methods, constructors, anonymous classes, enums (whose methods alone are nodes).
    ("java", "class A<T> {\n    int[] y = {1, 2};\n    A() { }\n    void m() throws E {\n        Runnable r = new Runnable() {\n            public void run() { }\n        };\n        foo(() -> { int q = 1; });\n    }\n    @Override\n    abstract int n(int a);\n    enum E { P; void z() {} }\n}\n",
     [("class_declaration", 1, 13), ("constructor_declaration", 3, 3), ("method_declaration", 4, 9), ("method_declaration", 6, 6), ("method_declaration", 10, 11), ("method_declaration", 12, 12)]),
    # Templates, raw strings, preprocessor lines, member prototypes (no nodes), local declarations.
    ("cpp", "#define X {\nnamespace n {\ntemplate <typename T>\nclass A : public B {\npublic:\n  int f() const { return x; }\n  int g();\n};\nint add(int a) {\n  for (int i = 0; i < 3; i++) { foo(i); }\n  return a;\n}\nconst char* s = R\"(})\";\n}\n",
     [("namespace_definition", 2, 14), ("class_specifier", 4, 8), ("function_definition", 6, 6), ("function_definition", 9, 12), ("declaration", 10, 10), ("declaration", 13, 13)]),
    # Raw strings and runes, groups, declarations within functions, function values.
    ("go", "package m\n\ntype T struct {\n\tA int\n}\n\nconst (\n\ta = 1\n)\nfunc (t *T) M() int {\n\tvar q int\n\treturn q\n}\nfunc F(a func(int) int) error {\n\ts := `}`\n\tgo func() { type L int }()\n\treturn nil\n}\n",
     [("type_declaration", 3, 5), ("const_declaration", 7, 9), ("method_declaration", 10, 13), ("var_declaration", 11, 11), ("function_declaration", 14, 18), ("type_declaration", 16, 16)]),
    # Decorators, heads on several lines, strings that look like code, one-line bodies.
    ("python", "@dec(1)\n@b\nclass A(\n    B,\n):\n    '''doc\ndef x'''\n\n    @p\n    async def f(self):\n        # c\n        return {\n1: 2}\n\n    def g(self): pass\n\nx = 3\n",
     [("decorated_definition", 1, 15), ("class_definition", 3, 15), ("decorated_definition", 9, 13), ("function_definition", 10, 13), ("function_definition", 15, 15)]),
]


@pytest.mark.parametrize(("language", "code", "want"), CASES, ids=[c[0] for c in CASES])
def test_nodes(language, code, want):
    assert [(kind, code.count("\n", 0, a) + 1, code.count("\n", 0, b) + 1) for a, b, kind in nodes(code, language)] == want


def test_node_texts():
    """A chunk is its node's own text: no indent before it, no semicolon after it."""
    code = "export const a = 1, f = async (x) => x / 2;\n  function g() {} ;\n"
    assert [c.content for c in split.split_syntax(code, "js", 2500, 0)] == ["export const a = 1, f = async (x) => x / 2;", "async (x) => x / 2", "function g() {}"]


@pytest.mark.parametrize(("language", "head"), [("java", "class A { void f( {\n"), ("javascript", "function f( {\n"), ("typescript", "a = (x: (\n"), ("rust", "fn f( {\n"), ("cpp", "int f( {\n"), ("go", "func f( {\n"), ("csharp", "class A { void f( {\n"), ("python", "def f(:\n")])
def test_open_brackets_take_linear_time(language, head):
    began = time.process_time()
    found = nodes(head * 8000, language)
    assert time.process_time() - began < 3  # a third of a second by itself
    assert sum(b - a for a, b, _ in found) <= len(head) * 8000  # and what stays open is no chunk, so chunks don't add up to more than the file


@pytest.mark.parametrize("language", sorted(set(NODES) - {"python", "scala"}))
def test_many_braces_in_one_statement_take_linear_time(language):
    began = time.process_time()
    nodes("x = " + "{} + " * 16_000, language)
    assert time.process_time() - began < 4  # half a second by itself


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="{}()[]<>;:,=\n \"'`/*#@$\\abfnclas", max_size=120), st.sampled_from(sorted(NODES)))
def test_any_text_is_read(code, language):
    for a, b, _ in nodes(code, language):
        assert 0 <= a < b <= len(code)


# ---------------------------------------------------------------- characters against a plain recursion


def plain_chars(text, seps, size, overlap):
    """The rule on strings: split at the first separator there is, join short neighbours, go on with long ones."""
    own = [s for s in seps if s == "" or s in text]
    if not own:
        return [text]
    sep, rest = own[0], seps[seps.index(own[0]) + 1 :]
    starts = list(range(len(text))) if sep == "" else [0] + [i for i in range(1, len(text)) if text.startswith(sep, i)]
    pieces = [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]
    out, run = [], []

    def join():
        held = []
        for p in run:
            if held and len("".join(held) + p) > size:
                out.append("".join(held))
                while held and (len("".join(held)) > overlap or len("".join(held) + p) > size):
                    held.pop(0)
            held.append(p)
        if held:
            out.append("".join(held))
        run.clear()

    for p in pieces:
        if len(p) < size or sep == "":
            run.append(p)
        else:
            join()
            out.extend(plain_chars(p, rest, size, overlap))
    join()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 40), st.integers(0, 12), st.sampled_from([None, "python"]))
def test_chars_plain(text, size, overlap, language):
    overlap = min(overlap, size - 1)
    want = [c.strip() for c in plain_chars(text, split.separators(language), size, overlap) if c.strip()]
    got = split.split_chars(text, language, size, overlap)
    assert [c.content for c in got] == want
    lines = text.split("\n")
    for c in got:  # where a chunk says it is, it is
        assert c.content in "\n".join(lines[c.start_line - 1 : c.end_line])
