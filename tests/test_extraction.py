from catalens.operators import extraction as ex

JS = r'''
server.tool("alpha", "Does \"alpha\"\n twice", { a: 1 });
server.registerTool('beta', { description: "Does beta", inputSchema: shape }, handler);
const tools = [{ name: "gamma", title: "G", description: "Does gamma", inputSchema: {} }];
const bare = [{ name: "plain",description: "no body", inputSchema: {} }];
server.tool("nested", { description: "x", inputSchema: {} });
'''
PY = '''
@app.tool()
async def delta(
    a,
    b,
):
    """Does
    delta."""
@app.server.tool(name="eps", description="Does eps")
def inner(): pass
@app.tool()
def _hidden(): pass
t = types.Tool(name="zeta", description="Does zeta", inputSchema={})
# Tool(name="commented", description="gone")
@app.other()
def ignored(): pass
'''


def files(spark, rows):
    return spark.createDataFrame(
        [(k, "s", kind, path, len(text), text) for k, kind, path, text in rows],
        "package_key string, server_name string, registry_type string, path string, bytes long, text string")


def test_javascript_idioms(spark):
    src = ex.select_source_files(files(spark, [("npm:p", "npm", "dist/a.js", JS)]))
    got = {r.tool_name: (r.tool_description, r.has_schema, r.extraction_pattern) for r in ex.extract_calls_js(src, ["path"]).collect()}
    assert got == {
        "alpha": ('Does "alpha" twice', False, "ts_server_tool"),
        "beta": ("Does beta", True, "ts_server_tool_object"),
        "gamma": ("Does gamma", False, "ts_tool_literal"),
        "plain": ("no body", True, "ts_tool_literal"),
        "nested": ("x", True, "ts_server_tool_object"),
    }


def test_python_idioms_and_second_opinion(spark):
    src = ex.select_source_files(files(spark, [("pypi:p", "pypi", "pkg/a.py", PY)]))
    first = {r.tool_name: (r.tool_description, r.has_schema) for r in ex.scan_files(src, ["path"]).collect()}
    assert first == {"delta": ("Does delta.", False), "eps": ("Does eps", False), "zeta": ("Does zeta", True), "commented": ("gone", False)}
    strict = {r.tool_name for r in ex.extract_strict(src, ["path"]).collect()}
    assert strict == {"delta", "eps", "zeta"} or strict == {"eps", "zeta", "delta"}


def test_long_descriptions_do_not_break_the_expression(spark):
    text = 'server.tool("a", "' + "word \\\" " * 110 + '", x);' + " { name: " * 2000
    src = ex.select_source_files(files(spark, [("npm:p", "npm", "a.ts", text)]))
    assert [r.tool_name for r in ex.scan_files(src, ["path"]).collect()] == ["a"]


def test_richest_definition_wins_and_ties_keep_the_first(spark):
    one = 'server.tool("a", "a longer description of the tool");\nserver.tool("a", { description: "short", inputSchema: s });\nserver.tool("b", "same");'
    two = 'server.tool("b", "tied");'
    src = ex.select_source_files(files(spark, [("npm:p", "npm", "1.js", one), ("npm:p", "npm", "2.js", two)]))
    got = {r.tool_name: (r.tool_description, r.path) for r in ex.extract_tools(src).collect()}
    assert got == {"a": ("short", "1.js"), "b": ("same", "1.js")}


def test_source_selection(spark):
    paths = ["src/a.ts", "src/a.d.ts", "lib/b.min.js", "node_modules/x/c.js", "src/test/d.py", "e.txt", "testing/f.py", "g.PY", "docs.py"]
    src = files(spark, [("k", "cargo", p, "x") for p in paths])
    kept = {r.path: r.language for r in ex.select_source_files(src).collect()}
    assert kept == {"src/a.ts": "typescript", "testing/f.py": "python", "g.PY": "python", "docs.py": "python"}
    npm = files(spark, [("k", "npm", "e.txt", "x")])
    assert [r.language for r in ex.select_source_files(npm).collect()] == ["javascript"]
    assert ex.select_source_files(npm, max_bytes=0).count() == 0


def test_no_limit_unless_asked_for(spark):
    src = files(spark, [("big", "npm", f"{i:03}.js", "x") for i in range(450)] + [("big", "npm", "long.js", "y" * 500_000)])
    assert ex.select_source_files(src).count() == 451


def test_file_limit_per_package(spark):
    src = files(spark, [("big", "npm", f"{i:03}.js", "x") for i in range(20)] + [("small", "npm", "a.js", "x")])
    kept = [(r.package_key, r.path) for r in ex.select_source_files(src, max_files=5).collect()]
    assert sorted(kept) == [("big", f"{i:03}.js") for i in range(5)] + [("small", "a.js")]


def test_snippets_take_context_and_the_first_hits(spark):
    text = "zero\none alpha\ntwo\nthree\nfour\nfive alpha beta\nsix"
    src = files(spark, [("p", "npm", "a.js", text), ("p", "npm", "b.js", "beta"), ("q", "npm", "c.js", "nothing")])
    terms = spark.createDataFrame([("p", ["alpha", "beta"]), ("q", ["zzz"])], "package_key string, terms array<string>")
    got = [(r.path, r.line_no, r.snippet) for r in ex.snippets(src, terms, n=2).orderBy("rank").collect()]
    assert got == [("a.js", 2, "zero\none alpha\ntwo\nthree\nfour"), ("a.js", 6, "four\nfive alpha beta\nsix")]


def test_long_definitions_are_found_whole(spark):
    name, words = "n" * 300, "very long words " * 400
    js = f'server.tool("{name}", "{words}", x)\nserver.registerTool("b", {{ description: "{words}", z: 1 }})\nconst t = {{ name: "c", {"k: 1, " * 900}description: "{words}" }}'
    py = f'Tool({"a=1, " * 700}name="{name}", description="{words}")\n@app.tool({"b=2, " * 300}name="d", description="{words}")\ndef f(): pass\n'
    src = files(spark, [("p", "npm", "a.js", js), ("p", "pypi", "b.py", py)])
    got = {r.tool_name: len(r.tool_description) for r in ex.scan_files(ex.select_source_files(src), ["path"]).collect()}
    assert set(got) == {name, "b", "c", "d"} and min(got.values()) >= len(words) - 1
