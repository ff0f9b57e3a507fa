"""Registrations in source text, delimited by their own brackets.

Regular expressions find where a registration begins; a pass over strings, comments and brackets finds where its arguments or its
body end, and what of them stands on their own level: what nested brackets hold and comments are left out. Tasks scan their files
batch by batch through Arrow; every result is a short list of hits, read further by column expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from catalens import fixed_values as fx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIT = "array<struct<extraction_pattern: string, position: int, name: string, body: string, description: string, after: string>>"

_PY_STRING = r'''"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+\''''
_JS_STRING = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`'''
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


def _tokens(strings: str, comments: str) -> re.Pattern:
    return re.compile(f"(?s){strings}|{comments}|[()\\[\\]{{}}]")


PYTHON, JAVASCRIPT = _tokens(_PY_STRING, r"#[^\n]*"), _tokens(_JS_STRING, r"//[^\n]*|/\*.*?\*/")
_QUOTES = frozenset("\"'`")


def closing(text: str, at: int, tokens: re.Pattern) -> int:
    """The place of the bracket that closes the one at `at`; -1 where none does."""
    depth = 0
    for m in tokens.finditer(text, at):
        c = m.group()
        depth += (c in _OPEN) - (c in _CLOSE)
        if not depth:
            return m.start()
    return -1


def own_level(text: str, start: int, end: int, tokens: re.Pattern) -> str:
    """The text between two places without comments and without what nested brackets hold."""
    out, last, depth = [], start, 0
    for m in tokens.finditer(text, start, end):
        c = m.group()
        if c in _OPEN:
            if not depth:
                out.append(text[last:m.end()])
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
            if not depth:
                last = m.start()
        elif not depth and c[0] not in _QUOTES:
            out.append(text[last:m.start()])
            last = m.end()
    return "".join(out) + ("" if depth else text[last:end])


def _javascript(text: str) -> list[tuple]:
    found = [("ts_server_tool", i, m[1], "", m[2], "") for i, m in enumerate(_CALL.finditer(text))]
    for i, m in enumerate(_CALL_WITH_BODY.finditer(text)):
        end = closing(text, m.end() - 1, JAVASCRIPT)
        if end >= 0:
            found.append(("ts_server_tool_object", i, m[1], own_level(text, m.end(), end, JAVASCRIPT), "", ""))
    heads = list(_LITERAL.finditer(text))
    for i, m in enumerate(heads):
        end = closing(text, m.start(), JAVASCRIPT)
        if end < 0:
            end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        own = own_level(text, m.end(), end, JAVASCRIPT)
        d = _DESCRIPTION.search(own)
        if d:
            body = own[:d.start()]
            schema = _SCHEMA.search(own) if body == "" else None
            found.append(("ts_tool_literal", i, m[1], body, d[1], schema.group() if schema else ""))
    return found


def _to_docstring(after: str) -> str:
    """What is read of the text behind a decorator: up to its function's docstring, or name if it has none; no function, no text."""
    head = _NEXT_FUNCTION.search(after)
    if not head:
        return ""
    last = _DOCSTRING.search(after, head.end()) or _NAME_ENDS.search(after, head.end())
    return after[:last.end()] if last else after


def _python(text: str) -> list[tuple]:
    found, heads = [], []
    for m in _DECORATOR.finditer(text):
        end = closing(text, m.end() - 1, PYTHON)
        if end >= 0:
            heads.append((m.start(), m.end(), end))
    for i, (_, start, end) in enumerate(heads):
        upto = heads[i + 1][0] if i + 1 < len(heads) else len(text)
        found.append(("py_decorator", i, None, own_level(text, start, end, PYTHON), "", _to_docstring(text[end + 1:upto])))
    for i, m in enumerate(_CONSTRUCTOR.finditer(text)):
        end = closing(text, m.end() - 1, PYTHON)
        if end >= 0:
            found.append(("py_tool_ctor", i, None, own_level(text, m.end(), end, PYTHON), "", ""))
    return found


# Blanks as the column expressions know them, which read the results with Unicode classes; Python counts four control characters more.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NEXT_FUNCTION = re.compile(fx.PY_NEXT_DEF.replace(r"\s", _BLANK))
_DOCSTRING = re.compile(f"(?s){fx.PY_DOCSTRING}".replace(r"\s", _BLANK))
_NAME_ENDS = re.compile(r"[(:\n]")
_SCHEMA = re.compile(fx.JS_SCHEMA, re.ASCII)
_CALL = re.compile(f"(?s){fx.JS_CALL}")
_CALL_WITH_BODY = re.compile(f"(?s){fx.JS_CALL_WITH_BODY}")
_LITERAL = re.compile(f"(?s){fx.JS_LITERAL}")
_DESCRIPTION = re.compile(f"(?s){fx.JS_DESCRIPTION}")
_DECORATOR = re.compile(f"(?s){fx.PY_DECORATOR}")
_CONSTRUCTOR = re.compile(f"(?s){fx.PY_CONSTRUCTOR}")


def _blanked(m: re.Match) -> str:
    """A string as its quotes with blanks between them, a comment as blanks, a bracket as it is; lengths and lines stay."""
    c = m.group()
    if len(c) == 1:
        return c
    inner = re.sub(r"[^\n]", " ", c[1:-1])
    return c[0] + inner + c[-1] if c[0] in _QUOTES else " " + inner + " "


_STRICT_DECORATOR = re.compile(fx.STRICT_DECORATOR)
_STRICT_CONSTRUCTOR = re.compile(fx.STRICT_CONSTRUCTOR)
_OTHER_DECORATOR = re.compile(r"\s*@[\w.]+[ \t]*")
_FUNCTION = re.compile(r"\s*(?:async\s+)?def\s+([^\W\d]\w*)")
_STRING = re.compile(f"(?s)[rRuU]?(?:{_PY_STRING})")
_BRACKETS = re.compile(r"[()\[\]{}]")


def _keyword(text: str, code: str, start: int, end: int, name: str) -> str | None:
    """The literal that a call between two places gives for a keyword on its own level; adjacent literals are joined."""
    depth, level = 0, []
    for m in _BRACKETS.finditer(code, start, end):
        level.append((m.start(), depth))
        depth += 1 if m.group() in _OPEN else -1
    for m in re.finditer(rf"(?:^|,)\s*{name}\s*=\s*", code[start:end]):
        at = start + m.end()
        nested = 0
        for place, _ in level:
            if place >= start + m.start():
                break
            nested += 1 if code[place] in _OPEN else -1
        if nested:
            continue
        parts = []
        while literal := _STRING.match(text, at, end):
            raw = literal.group().lstrip("rRuU")
            quote = 3 if raw[:3] in ('"""', "'''") else 1
            parts.append(raw[quote:-quote])
            at = literal.end() + len(code[literal.end():end]) - len(code[literal.end():end].lstrip())
        return "".join(parts) if parts else None
    return None


def strict_hits(text: str) -> list[tuple]:
    """The second opinion: decorators above a function and constructor calls, both outside strings and comments.

    A decorator's arguments and those below it may span lines; the name is the keyword on the call's own level, else
    the function's. A name is private only if the function is private too.
    """
    code = PYTHON.sub(_blanked, text)
    found = []
    for i, m in enumerate(_STRICT_DECORATOR.finditer(code)):
        at, name = m.end(), None
        if code[at:at + 1] == "(":
            end = closing(code, at, _BRACKETS)
            if end < 0:
                continue
            name, at = _keyword(text, code, at + 1, end, "name"), end + 1
        while other := _OTHER_DECORATOR.match(code, at):
            at = other.end()
            if code[at:at + 1] == "(":
                at = closing(code, at, _BRACKETS) + 1
                if not at:
                    break
        function = _FUNCTION.match(code, at) if at else None
        if function and not ((name or function[1]).startswith("_") and function[1].startswith("_")):
            found.append(("strict_decorator", i, name or function[1], "", "", ""))
    for i, m in enumerate(_STRICT_CONSTRUCTOR.finditer(code)):
        end = closing(code, m.end() - 1, _BRACKETS)
        name = _keyword(text, code, m.end(), end, "name") if end >= 0 else None
        if name:
            found.append(("strict_ctor", i, name, "", "", ""))
    return found


#: Files whose texts and hits are Python objects at a time; a batch of files is larger.
SLICE = 64
_FIELDS = ("extraction_pattern", "position", "name", "body", "description", "after")


def _column(scan):
    """A column expression over (text, language) from a function of one text and its language."""

    @F.arrow_udf(HIT)
    def run(texts, languages):
        import pyarrow as pa

        many = pa.list_(pa.struct([(n, pa.int32() if n == "position" else pa.string()) for n in _FIELDS]))
        parts = [pa.array([], many)]
        for at in range(0, len(texts), SLICE):
            pairs = zip(texts.slice(at, SLICE).to_pylist(), languages.slice(at, SLICE).to_pylist())
            parts.append(pa.array([[dict(zip(_FIELDS, h)) for h in scan(t, k)] if t else [] for t, k in pairs], many))
        return pa.concat_arrays(parts)

    return run


def _scan(text: str, language: str | None) -> list[tuple]:
    return _python(text) if language == "python" else _javascript(text) if language in ("javascript", "typescript") else []


def registrations(text: Column, language: Column, patterns: Sequence[str]) -> Column:
    """Hits of the given idioms of a file's language; none for null, empty and other texts."""
    wanted = frozenset(patterns)
    return _column(lambda t, k: [h for h in _scan(t, k) if h[0] in wanted])(text, language)


def strict_registrations(text: Column, language: Column) -> Column:
    """Hits of the second opinion in Python files; none for null, empty and other texts."""
    return _column(lambda t, k: strict_hits(t) if k == "python" else [])(text, language)
