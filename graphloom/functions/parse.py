"""Extraction with scopes: declarations, imports, calls with the function that makes them, heritage and test names.

Python is read with its own parser. The other languages are read from a masked copy of the text (comments and the insides
of strings blanked, so that places and lines stay): declarations are found by pattern, their extents by matching braces,
and whatever lies inside an extent belongs to the innermost one. A file that Python's parser refuses gives no rows but an
error row; unbalanced braces end with the file.

Defined results: a null or empty content has no rows; a name that is declared twice in a file has one symbol, at its first
line; calls outside any function have an empty scope. Files are read one at a time.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: kind: class, interface, enum, struct, trait, type, module, function, method or test (name, scope: the class, public: by the
#: language's own rule); import (name: local name, or * for a namespace, target: as written, scope: the imported name); call
#: (name as written, scope: the calling symbol); extends and implements (name: the child, target: the parent); error.
ROW = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("public", T.BooleanType()),
])

_MASK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?""", re.S)
_MASK_RUST = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"?|'(?:\\.[^']*|[^'\\])'""", re.S)
_MASK_PHP = re.compile(_MASK.pattern + r"|\#(?!\[)[^\n]*", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
_MODIFIERS = r"(?:(?:public|protected|private|internal|static|final|abstract|virtual|override|sealed|async|readonly|synchronized|partial|native|default|const|export|declare|get|set|unsafe|extern)\s+)*"
_TS = [
    ("class", rf"\bclass\s+(?P<n>{_NAME})(?:\s*<[^{{]*?>)?(?:\s+extends\s+(?P<e>[\w$.]+))?(?:\s*<[^{{]*?>)?(?:\s+implements\s+(?P<i>[\w$.,\s<>]+))?"),
    ("interface", rf"\binterface\s+(?P<n>{_NAME})(?:\s*<[^{{]*?>)?(?:\s+extends\s+(?P<i>[\w$.,\s<>]+))?"),
    ("enum", rf"\benum\s+(?P<n>{_NAME})"),
    ("type", rf"\btype\s+(?P<n>{_NAME})\s*(?:<[^=]*>)?\s*="),
    ("function", rf"\bfunction\s*\*?\s*(?P<n>{_NAME})\s*[(<]"),
    ("function", rf"\b(?:const|let|var)\s+(?P<n>{_NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={{;]+)?=>|{_NAME}\s*=>)"),
    ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*{_MODIFIERS}\*?\s*(?P<n>\#?{_NAME})\s*(?:<[^(]*>)?\([^;{{}}]*\)\s*(?::[^;{{]+)?(?=\{{)"),
]
_BRACED = r"\s+(?P<n>[A-Za-z_]\w*)"
#: By language: declarations (kind, pattern with the groups n name, e one parent, i parents after commas, t receiver).
DECLARATIONS = {
    "TypeScript": _TS,
    "JavaScript": _TS,
    "Java": [
        ("class", rf"\b(?:class|record){_BRACED}(?:\s*<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<e>[\w.]+))?(?:\s*<[^{{]*?>)?(?:\s+implements\s+(?P<i>[\w.,\s<>]+))?"),
        ("interface", rf"\binterface{_BRACED}(?:\s*<[^{{]*?>)?(?:\s+extends\s+(?P<i>[\w.,\s<>]+))?"),
        ("enum", rf"\benum{_BRACED}"),
        ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:@\w+\s+)*{_MODIFIERS}(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<n>[A-Za-z_]\w*)\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)"),
    ],
    "C#": [
        ("class", rf"\b(?:class|record){_BRACED}(?:\s*<[^{{]*?>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<x>[\w.,\s<>]+))?"),
        ("struct", rf"\bstruct{_BRACED}(?:\s*:\s*(?P<x>[\w.,\s<>]+))?"),
        ("interface", rf"\binterface{_BRACED}(?:\s*<[^{{]*?>)?(?:\s*:\s*(?P<x>[\w.,\s<>]+))?"),
        ("enum", rf"\benum{_BRACED}"),
        ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:\[[^\]]*\]\s*)*{_MODIFIERS}(?:[\w<>\[\],.?]+\s+)?(?P<n>~?[A-Za-z_]\w*)\s*(?:<[^(]*>)?\([^;{{}}()]*\)\s*(?:where[^{{;]+)?(?=\{{|=>)"),
    ],
    "PHP": [
        ("class", rf"\bclass{_BRACED}(?:\s+extends\s+(?P<e>[\w\\]+))?(?:\s+implements\s+(?P<i>[\w\\,\s]+))?"),
        ("interface", rf"\binterface{_BRACED}(?:\s+extends\s+(?P<i>[\w\\,\s]+))?"),
        ("trait", rf"\btrait{_BRACED}"),
        ("function", r"\bfunction\s+&?(?P<n>[A-Za-z_]\w*)\s*\("),
    ],
    "Go": [
        ("struct", r"(?m)^type\s+(?P<n>[A-Za-z_]\w*)\s+struct\b"),
        ("interface", r"(?m)^type\s+(?P<n>[A-Za-z_]\w*)\s+interface\b"),
        ("type", r"(?m)^type\s+(?P<n>[A-Za-z_]\w*)\s+(?!struct\b|interface\b)"),
        ("function", r"(?m)^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<t>[A-Za-z_]\w*)[^)]*\)\s*)?(?P<n>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\("),
    ],
    "Rust": [
        ("struct", r"\bstruct\s+(?P<n>[A-Za-z_]\w*)"),
        ("enum", r"\benum\s+(?P<n>[A-Za-z_]\w*)"),
        ("trait", r"\btrait\s+(?P<n>[A-Za-z_]\w*)"),
        ("module", r"\bmod\s+(?P<n>[A-Za-z_]\w*)\s*(?=\{)"),
        ("impl", r"\bimpl(?:\s*<[^{]*?>)?\s+(?:(?P<e>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<n>[A-Za-z_]\w*)"),
        ("function", r"\bfn\s+(?P<n>[A-Za-z_]\w*)\s*[(<]"),
    ],
}
_SCOPES = ("class", "interface", "struct", "trait", "impl")
_NO_CALL = frozenset(
    "if for while switch catch return async function typeof new await super match fn func def class sizeof elif with foreach unless using lock nameof throw yield print echo isset empty array list unset make append cap len copy delete panic range".split()
)
_CALL = re.compile(rf"(?<![\w$.>:])((?:{_NAME}\s*(?:\.|::|->)\s*)*{_NAME})!?\s*(?:<[\w\s,.]*>)?\(")
_TEST = re.compile(r"\b(describe|context|suite|it|test)(?:\.\w+)*\s*\(\s*(['\"`])")
_TS_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s*as\s+([\w$]+)\s*|\{([^}]*)\}\s*)?(?:from\s*)?['"]([^'"]+)['"]|(?:\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*)?\brequire\(\s*['"]([^'"]+)['"]\s*\)""")
_LIST_IMPORTS = {
    "Go": re.compile(r"""(?m)^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"\s]+)"\s*$"""),
    "Java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?()([\w.*]+)\s*;"),
    "Rust": re.compile(r"(?m)^\s*(?:pub\s+)?use\s+()([\w:]+)"),
    "PHP": re.compile(r"(?m)^\s*use\s+()([\w\\]+)(?:\s+as\s+\w+)?\s*;"),
    "C#": re.compile(r"(?m)^\s*using\s+(?:(\w+)\s*=\s*)?([\w.]+)\s*;"),
}


@dataclass
class Found:
    kind: str
    name: str
    start: int
    stop: int
    public: bool = True


def masked(text: str, language: str) -> str:
    """The text with comments and the insides of strings as blanks."""
    blank = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0])
    return {"Rust": _MASK_RUST, "PHP": _MASK_PHP}.get(language, _MASK).sub(blank, text)


def _pairs(text: str) -> dict[int, int]:
    """The place of the closing brace or parenthesis of each opening one."""
    out, open_ = {}, []
    for m in re.finditer(r"[(){}]", text):
        if m[0] in "({":
            open_.append(m.start())
        else:
            want = "(" if m[0] == ")" else "{"
            while open_ and text[open_[-1]] != want:
                out[open_.pop()] = m.start()
            if open_:
                out[open_.pop()] = m.start()
    return out | dict.fromkeys(open_, len(text))


def _stop(text: str, pairs: dict[int, int], at: int) -> int:
    """The end of what is declared up to a place: of its braces, or of the line where it has none."""
    m = re.compile(r"[{;]|\n\s*\n").search(text, at)
    if m and m[0] == "{":
        return pairs[m.start()]
    line = text.find("\n", at)
    return len(text) if line < 0 else line


def _names(text: str | None) -> list[str]:
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", text or ""))
    return [x for x in (p.strip().split(" ")[0] for p in flat.split(",")) if x]


def _bindings(text: str | None) -> list[tuple[str, str]]:
    """(local, imported) of the names between the braces of an import."""
    out = []
    for part in (text or "").split(","):
        words = re.split(r"\s+as\s+|\s*:\s*", part.strip().removeprefix("type "))
        if words[0]:
            out.append((words[-1], words[0]))
    return out


def braced(text: str, language: str) -> Iterator[dict]:
    """Rows of a file of any language but Python."""
    plain = masked(text, language)
    pairs = _pairs(plain)
    lines = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(lines, at - 1) + 1 if at else 1
    found: list[Found] = []
    heritage: list[tuple[str, str, str, int]] = []
    taken: set[int] = set()
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, plain):
            at, name = m.start("n"), m["n"]
            if at in taken or name in _NO_CALL:
                continue
            taken.add(at)
            stop = _stop(plain, pairs, m.end() - (plain[m.end() - 1] == "{"))
            if kind == "method" and plain[m.end() : m.end() + 1] == "=":
                stop = _stop(plain, pairs, m.end())
            groups = m.groupdict()
            full = f"{groups['t']}.{name}" if groups.get("t") else name
            found.append(Found(kind, full, at, stop, _public(language, name, plain[max(0, m.start() - 40) : at])))
            for group, relation in (("e", "implements" if kind == "impl" else "extends"), ("i", "extends" if kind == "interface" else "implements"), ("x", "extends")):
                heritage += [(name, relation, p, at) for p in _names(groups.get(group))]
    found.sort(key=lambda f: (f.start, -f.stop))
    scopes = [f for f in found if f.kind in _SCOPES]
    inside = lambda at, some, starts: next((f for f in reversed(some[: bisect_right(starts, at)]) if f.stop > at), None)
    begins = [s.start for s in scopes]
    declared: list[Found] = []
    for f in found:
        holder = inside(f.start - 1, scopes, begins)
        if f.kind == "impl":
            continue
        if f.kind == "method" or f.kind == "function" and holder and language in ("Rust", "PHP"):
            if not holder:
                continue
            f.kind, f.name = "method", f"{holder.name}.{f.name}"
        elif f.kind == "function" and "." in f.name:
            f.kind = "method"
        declared.append(f)
    for f in declared:
        holder = f.name.rpartition(".")[0] or None
        yield {"kind": f.kind, "name": f.name, "target": None, "scope": holder, "line": line(f.start), "public": f.public}
    for child, relation, parent, at in heritage:
        yield {"kind": relation, "name": child, "target": parent.replace("::", ".").split("\\")[-1], "scope": None, "line": line(at), "public": None}
    callers = [f for f in declared if f.kind in ("function", "method")]
    begins, starts = [f.start for f in callers], {f.start for f in found}
    for m in _CALL.finditer(plain):
        name = re.sub(r"\s*(?:\.|::|->)\s*", ".", m[1])
        before = plain[max(0, m.start() - 12) : m.start()]
        if name in _NO_CALL or m.start() in starts or re.search(r"\b(?:function|func|fn|def)\s+\*?$", before):
            continue
        caller = inside(m.start(), callers, begins)
        yield {"kind": "call", "name": name, "target": None, "scope": caller.name if caller else "", "line": line(m.start()), "public": None}
    seen = lambda m: plain[m.start() : m.start() + 1] == text[m.start() : m.start() + 1]
    if language in ("TypeScript", "JavaScript"):
        for m in _TS_IMPORT.finditer(text):
            if not seen(m):
                continue
            target = m[4] or m[7]
            some = [*([(m[1], "default")] if m[1] else []), *([(m[2], "*")] if m[2] else []), *_bindings(m[3]), *([(m[5], "*")] if m[5] else []), *_bindings(m[6])]
            for local, name in some or [("", "")]:
                yield {"kind": "import", "name": local, "target": target, "scope": name, "line": line(m.start()), "public": None}
        yield from _tests(text, plain, pairs, line)
    else:
        for m in _LIST_IMPORTS[language].finditer(text):
            if seen(m) and m[2]:
                last = re.split(r"[./:\\]", m[2])[-1]
                yield {"kind": "import", "name": m[1] or last, "target": m[2], "scope": "*" if language in ("Go", "C#") else last, "line": line(m.start(2)), "public": None}


def _public(language: str, name: str, before: str) -> bool:
    words = before[before.rfind("\n") + 1 :]
    if language == "Rust":
        return "pub" in words.split() or "pub(" in words
    if language == "Go":
        return True
    return not re.search(r"\b(?:private|protected|internal)\b", words) and not name.startswith("#")


def _tests(text: str, plain: str, pairs: dict[int, int], line) -> Iterator[dict]:
    """Names of it() and test() below those of the describe() around them."""
    held: list[tuple[int, str]] = []
    for m in _TEST.finditer(plain):
        begin = m.end()
        stop = re.compile(rf"(?<!\\){re.escape(m[2])}").search(text, begin)
        name = text[begin : stop.start() if stop else len(text)]
        end = pairs.get(plain.index("(", m.start()), len(text))
        held = [(e, n) for e, n in held if e > m.start()]
        if m[1] in ("it", "test"):
            yield {"kind": "test", "name": " › ".join([*(n for _, n in held), name]), "target": None, "scope": None, "line": line(m.start()), "public": None}
        else:
            held.append((end, name))


_BUILTINS = frozenset("print len range str int float list dict set tuple super isinstance open type".split())


def python(text: str) -> Iterator[dict]:
    """Rows of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield {"kind": "error", "name": type(e).__name__, "target": None, "scope": None, "line": getattr(e, "lineno", None) or 1, "public": None}
        return

    def dotted(node: ast.expr) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    stack: list[tuple[ast.AST, str | None, str]] = [(x, None, "") for x in reversed(tree.body)]
    while stack:  # a node, the class around it, the function around it
        node, holder, caller = stack.pop()
        inner = (holder, caller)
        row = {"target": None, "scope": holder, "line": getattr(node, "lineno", 1), "public": None}
        if isinstance(node, ast.ClassDef):
            yield row | {"kind": "class", "name": node.name, "scope": None, "public": not node.name.startswith("_")}
            for base in node.bases:
                parent = dotted(base)
                if parent and parent != "object":
                    yield row | {"kind": "extends", "name": node.name, "target": parent, "scope": None}
            inner = (node.name, caller)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            marks = {dotted(d) for d in node.decorator_list}
            bare = bool(marks & {"staticmethod", "classmethod", "property"}) or node.name.startswith("__") and node.name.endswith("__")
            name = f"{holder}.{node.name}" if holder and not bare else node.name
            yield row | {"kind": "method" if holder else "function", "name": name, "public": not node.name.startswith("_") or node.name.startswith("__")}
            if node.name.startswith("test_"):
                yield row | {"kind": "test", "name": " › ".join([*([holder] if holder else []), node.name]), "scope": None}
            inner = (None, name)
        elif isinstance(node, ast.Import):
            for x in node.names:
                yield row | {"kind": "import", "name": x.asname or x.name.partition(".")[0], "target": x.name, "scope": "*"}
        elif isinstance(node, ast.ImportFrom):
            target = "." * node.level + (node.module or "")
            for x in node.names:
                yield row | {"kind": "import", "name": x.asname or x.name, "target": target, "scope": x.name}
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            if name and name not in _BUILTINS:
                yield row | {"kind": "call", "name": name, "scope": caller}
        stack += [(x, *inner) for x in reversed(list(ast.iter_child_nodes(node)))]


def rows_of(path: str, language: str, content: str | None) -> list[dict]:
    """The rows of a file; symbols and calls once, at their first line."""
    if not content or not (language == "Python" or language in DECLARATIONS):
        return []
    first: dict[tuple, dict] = {}
    for r in python(content) if language == "Python" else braced(content, language):
        first.setdefault((r["kind"], r["name"], r["target"], r["scope"]), {"path": path, **r})
    return list(first.values())


def parsed(files: DataFrame) -> DataFrame:
    """The rows of files (path, language, content); see ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for path, language, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                yield pa.RecordBatch.from_pylist(rows_of(path.as_py(), language.as_py(), content.as_py()), schema=to_arrow_schema(ROW))

    return files.select("path", "language", "content").mapInArrow(run, ROW)
