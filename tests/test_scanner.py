"""Registrations delimited by their own brackets; the second opinion against Python's syntax tree."""

import ast
import random

from catalens.functions import scanner
from catalens.functions.scanner import JAVASCRIPT, closing, own_level, strict_hits
from catalens.operators import extraction as ex
from tests_files import files

MULTI = '''
@app.tool(
    name="reader",  # not name="this"
    description="Reads (all) files :)",
    tags={"name": ("x", [1])},
)
@cached(
    size=3)
async def inner(): pass
class C:
    @tool
    def bare(self): pass
    @mcp_tool()
    def _private(self): pass
    @server_tool(name="_p")
    def _gone(self): pass
pair = [Tool(name="one", description="a ) b", inputSchema={"name": other(name="no")}), x.ToolSpec(description="d", name="t" "wo")]
text = "Tool(name='in a string')"  # Tool(name="in a comment")
"""
@app.tool()
def in_docstring(): pass
"""
Tool(name=variable); Tool(dict(name="inside")); Tool(name="never closed"
'''


def syntax_tree_names(text):
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in node.decorator_list:
                call, f = (d, d.func) if isinstance(d, ast.Call) else (None, d)
                given = [k.value.value for k in call.keywords if k.arg == "name"] if call else []
                name = given[0] if given else node.name
                if getattr(f, "attr", getattr(f, "id", "")) in ("tool", "mcp_tool", "server_tool") and not (
                        name.startswith("_") and node.name.startswith("_")):
                    out.append(name)
        elif isinstance(node, ast.Call) and getattr(node.func, "attr", getattr(node.func, "id", "")) in ("Tool", "ToolSpec"):
            out += [k.value.value for k in node.keywords if k.arg == "name"]
    return sorted(out)


def test_second_opinion_agrees_with_the_syntax_tree():
    random.seed(4)
    for _ in range(300):
        parts = []
        for i in range(random.randint(1, 8)):
            args = random.sample([f'name="n{i}"', "description='a ) \\' ('", "x={'name': [1, (2)]}", "y=f(name='inner')", '"""p\n)"""', "z=1"], random.randint(0, 4))
            args.sort(key=lambda a: "=" in a)  # positional ones first
            sep = random.choice([", ", ",\n    ", ',  # name="c" )\n    '])
            call = f"({sep.join(args)}{random.choice(['', chr(10)])})"
            parts.append(random.choice([
                f"@app.tool{call}\ndef f{i}(a=(1, 2)):\n    '''doc @tool'''\n    pass", f"@a.b.mcp_tool{call}\n@other(1,\n 2)\nasync def _g{i}(): pass",
                f"@tool\ndef h{i}(): pass", f"v = [Tool{call}, m.ToolSpec{call}]", "s = \"Tool(name='q')\"  # @x.tool()", f"@app.toolbox{call}\ndef k{i}(): pass"]))
        text = "\n".join(parts) + "\n"
        assert sorted(h[2] for h in strict_hits(text)) == syntax_tree_names(text), text


def test_second_opinion_reads_multi_line_code(spark):
    src = ex.select_source_files(files(spark, [("pypi:p", "pypi", "a.py", MULTI), ("pypi:p", "pypi", "b.py", ""), ("npm:p", "npm", "c.js", MULTI)]))
    strict = sorted((r.tool_name, r.extraction_pattern) for r in ex.extract_strict(src, ["path"]).collect())
    assert strict == [("bare", "strict_decorator"), ("one", "strict_ctor"), ("reader", "strict_decorator"), ("two", "strict_ctor")]


def test_first_opinion_reads_to_the_own_closing_bracket(spark):
    js = """s.registerTool("deep", { inputSchema: { a: { description: "arg }" } }, /* } */ description: `T } x` }, f);
const l = [{ name: "lit", meta: { schema: 1 }, description: "L" }, { name: "two",description: "M", input_schema: { a: {} } }, { name: "none", x: { description: "deep only" } }]"""
    python = MULTI + "\n@x.tool()\n" + "# far\n" * 2000 + "def far():\n    '''Far\n away'''\n"
    src = ex.select_source_files(files(spark, [("npm:p", "npm", "a.ts", js), ("pypi:p", "pypi", "a.py", python)]))
    got = {r.tool_name: (r.tool_description, r.has_schema) for r in ex.scan_files(src, ["path"]).collect()}
    assert {k: got[k] for k in ("deep", "lit", "two", "reader", "one", "far")} == {
        "deep": ("T } x", True), "lit": ("L", False), "two": ("M", True), "reader": ("Reads (all) files :)", False), "one": ("a ) b", True), "far": ("Far away", False)}
    assert "none" not in got and "never closed" not in got


def test_own_level_and_closing():
    text = '{ a: [1, { b: ")" }], /* } */ c: "x}" } rest'
    end = closing(text, 0, JAVASCRIPT)
    assert text[end:] == "} rest" and own_level(text, 1, end, JAVASCRIPT) == ' a: [],  c: "x}" '
    assert closing("({", 0, JAVASCRIPT) == -1


def test_hits_hold_no_more_text_than_is_read():
    tail = "long tail: 'of' prose \n" * 50_000
    python = '@app.tool()\ndef f(a):\n    """Doc."""\n' + tail + "@app.tool()\ndef g(a): pass\n" + tail + "@app.tool()\n" + tail
    assert [h[5] for h in scanner._python(python)] == ['\ndef f(a):\n    """Doc."""', "\ndef g(", ""]
    assert [h[5] for h in scanner._javascript("{ name: 'a',description: 'd', inputSchema : x, " + tail)] == ["inputSchema :"]


def test_shortened_hits_read_the_same(spark, monkeypatch):
    random.seed(6)
    pieces = ["@app.tool()\n", "@a.tool(name='n')\n", "\nasync def f(a, b):\n", "\n\x85 def g", "\n\x1cdef h(", "\ndef _p():", ":\n  r'''one\n two'''", ': """x"""', ": '''open", "é", "(", " \n", "　",
              "text", "\n async def ḱ:", '"""', "{ name: 'j', description: 'd', ", "{ name: 'i',description: \"e\", schema :", "Schema :", "}", "ſchema:"]
    texts = ["@app.tool()\n" + "".join(random.choices(pieces, k=12)) for _ in range(1200)]
    src = ex.select_source_files(files(spark, [("p", "npm", f"a{i}.{'ts' if i % 3 == 0 else 'py'}", t) for i, t in enumerate(texts)]))
    read = lambda: sorted(map(str, ex.scan_files(src, ["path"]).collect()))
    short = read()
    monkeypatch.setattr(scanner, "_to_docstring", lambda after: after)
    monkeypatch.setattr(scanner, "SLICE", 7)
    assert short == read() and len(short) > 300
