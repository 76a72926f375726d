"""Languages read by a lexical scan: patterns per language over text whose comments and strings are blanked.

An approximation of a grammar: definitions, imports and calls are found by pattern, and a
definition's end by its closing bracket, ``end`` keyword or indentation. Bodies, names and
lines are right for conventional code; macros and exotic syntax are missed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .base import Facts, register

DOC_LENGTH = 400
NOT_CALLS = frozenset("if for while switch catch return match with fn func function def do else elsif unless when case typeof new sizeof super await and or not in".split())


@dataclass
class Syntax:
    """Patterns of a language. A definition pattern has the group ``name`` and may have ``owner``; an import pattern ``spec``, ``names``, ``whole`` or ``default``."""

    line_comment: str
    defs: list[tuple[str, str]]
    imports: list[str]
    block_comment: str | None = r"/\*.*?\*/"
    ends: str = "brace"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    exported: str | None = None
    this: tuple[str, ...] = ("this",)
    binds: list[str] = field(default_factory=list)
    routes: list[str] = field(default_factory=list)
    requests: list[str] = field(default_factory=list)
    reexports: list[str] = field(default_factory=list)
    test_scope: str | None = None
    macros: Callable | None = None


def blanked(text: str, syntax: Syntax) -> str:
    """The text with comments and the insides of strings as spaces, so places stay."""
    pattern = "|".join(filter(None, [syntax.block_comment, syntax.line_comment, syntax.strings]))

    def blank(m: re.Match) -> str:
        s = m[0]
        keep = s[:1] in "\"'`" and len(s) > 1
        inner = re.sub(r"[^\n]", " ", s[1:-1] if keep else s)
        return s[0] + inner + s[-1] if keep else inner

    return re.sub(pattern, blank, text, flags=re.S)


def end_of(clean: str, at: int, how: str) -> int:
    """Where a definition that starts at a place ends."""
    if how == "brace":
        opened = re.compile(r"[{;]").search(clean, at)
        arrow = clean.find("\n", at)
        if not opened or clean[opened.start()] == ";":
            return opened.start() if opened else arrow if arrow >= 0 else len(clean)
        depth = 0
        for m in re.compile(r"[{}]").finditer(clean, opened.start()):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.start()
        return len(clean)
    line = clean.rfind("\n", 0, at) + 1
    indent = len(clean[line:]) - len(clean[line:].lstrip(" \t"))
    for m in re.compile(r"^([ \t]*)(end\b|\S)", re.M).finditer(clean, clean.find("\n", at) + 1 or len(clean)):
        width = len(m[1])
        if how == "end" and m[2] == "end" and width == indent:
            return m.start()
        if how == "end" and width <= indent and m[2] != "end":
            return max(at, m.start() - 1)
    return len(clean)


def doc_above(lines: list[str], line: int, marks: str) -> str | None:
    """The run of comment lines right above a line (1-based), decorators passed over."""
    out, i = [], line - 2
    while i >= 0 and lines[i].lstrip().startswith(("@", "#[")) and not lines[i].lstrip().startswith("@doc"):
        i -= 1
    while i >= 0 and re.match(rf"\s*(?:{marks})", lines[i]):
        out.append(re.sub(rf"^\s*(?:{marks})+\s?|\*/\s*$", "", lines[i]).strip())
        i -= 1
    text = " ".join(filter(None, reversed(out))).strip()
    return text[:DOC_LENGTH] or None


def scan(text: str, syntax: Syntax) -> Facts:
    clean = blanked(text, syntax)
    lines = text.split("\n")
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    import bisect

    line_of = lambda at: bisect.bisect_right(starts, at)
    defs, facts = [], []
    heads = set()
    for kind, pattern in syntax.defs:
        for m in re.compile(pattern, re.M).finditer(clean):
            name = m["name"]
            if name in NOT_CALLS or m.start("name") in heads:
                continue
            heads.add(m.start("name"))
            end = end_of(clean, m.end(), syntax.ends)
            own = m.groupdict().get("owner")
            defs.append([m.start("name"), end, kind, name, own, m[0], line_of(m.start("name")), line_of(max(m.start("name"), end))])
    defs.sort()
    for d in defs:
        around = [x for x in defs if x is not d and x[0] < d[0] <= x[1] and x[2] in ("Class", "Module", "Interface", "Enum", "Type")]
        owner = d[4] or (around[-1][3] if around else None)
        kind = "Method" if d[2] == "Function" and owner and (d[4] or around[-1][2] in ("Class", "Interface", "Type", "Enum")) else d[2]
        q = ".".join([*(x[3] for x in around), *([d[4]] if d[4] else []), d[3]])
        shown = True if syntax.exported is None else bool(re.search(syntax.exported, d[5])) if syntax.exported != "upper" else d[3][:1].isupper()
        facts.append({"fact": "def", "name": d[3], "qualified_name": q, "kind": kind, "owner": owner, "start_line": d[6], "end_line": d[7], "col": d[0] - starts[d[6] - 1] + 1, "is_exported": shown,
                      "doc": doc_above(lines, d[6], r"///?|#|\*|/\*\*?|--|;;")})
    for pattern in syntax.imports:
        for m in re.compile(pattern, re.M).finditer(text):
            if clean[m.start()] == " " and text[m.start()] != " ":
                continue
            g = m.groupdict()
            base = {"fact": "import", "spec": g["spec"].strip(), "start_line": line_of(m.start()), "end_line": line_of(m.end())}
            some = False
            for part in re.split(r"\s*,\s*", (g.get("names") or "").strip()):
                n = re.match(r"(?:type\s+)?(\w+)(?:\s*(?:as|:)\s*(\w+))?$", part)
                if n:
                    facts.append(base | {"imported": n[1], "local": n[2] or n[1]})
                    some = True
            if g.get("default"):
                facts.append(base | {"imported": "default", "local": g["default"]})
                some = True
            if g.get("whole"):
                facts.append(base | {"imported": "*", "local": g["whole"]})
                some = True
            if not some:
                local = re.split(r"[/.:\\]", base["spec"].strip("/"))[-1]
                facts.append(base | {"imported": "*", "local": local})
    for pattern in syntax.reexports:
        for m in re.compile(pattern, re.M).finditer(text):
            g = m.groupdict()
            if g.get("names"):
                for part in re.split(r"\s*,\s*", g["names"].strip()):
                    n = re.match(r"(\w+)(?:\s+as\s+(\w+))?$", part)
                    if n:
                        facts.append({"fact": "reexport", "spec": g["spec"], "imported": n[1], "name": n[2] or n[1], "start_line": line_of(m.start())})
            else:
                facts.append({"fact": "reexport", "spec": g["spec"], "imported": "*", "name": "*", "start_line": line_of(m.start())})
    for m in re.compile(r"(?:(?P<new>new\s+(?P<made>\w+)\s*\([^()\n]*\)\s*\.)|(?P<recv>[\w$@]+(?:(?:\.|::|->)\w+)*)(?:\.|::|->))?(?P<name>[\w$]+[!?]?)\s*\(").finditer(clean):
        name = m["name"]
        if name in NOT_CALLS or m.start("name") in heads or name.isdigit():
            continue
        fact = {"fact": "ref", "name": name, "start_line": line_of(m.start("name")), "col": m.start("name") - starts[line_of(m.start("name")) - 1] + 1}
        recv = m["recv"]
        if m["new"]:
            fact |= {"recv_kind": "new", "recv_text": m["made"]}
        elif recv in syntax.this:
            fact |= {"recv_kind": "this", "recv_text": recv}
        elif recv and (recv[0].isupper() or "::" in m[0]):
            fact |= {"qualifier": re.split(r"\.|::|->", recv)[-1], "recv_text": recv}
        elif recv:
            fact |= {"recv_kind": "ident" if re.fullmatch(r"[\w$@]+", recv) else "other", "recv_text": recv.lstrip("$@")}
        facts.append(fact)
    for pattern in syntax.binds:
        for m in re.compile(pattern, re.M).finditer(clean):
            inside = [d for d in defs if d[0] < m.start() <= d[1]]
            a, b = (inside[-1][6], inside[-1][7]) if inside else (1, len(lines))
            facts.append({"fact": "bind", "name": m["name"].lstrip("$"), "start_line": line_of(m.start("name")), "type": m.groupdict().get("type") or "", "scope_start": a, "scope_end": b})
    for patterns, fact in ((syntax.routes, "provide"), (syntax.requests, "consume")):
        for pattern in patterns:
            for m in re.compile(pattern, re.M).finditer(text):
                verb = (m.groupdict().get("verb") or "get").upper()
                facts.append({"fact": fact, "transport": "Http", "method": verb, "path": m["path"], "name": m.groupdict().get("handler"), "start_line": line_of(m.start())})
    if syntax.macros:
        facts += syntax.macros(text, clean, line_of, lambda at: end_of(clean, at, syntax.ends))
    if syntax.test_scope:
        for m in re.compile(syntax.test_scope, re.M).finditer(clean):
            facts.append({"fact": "test_scope", "start_line": line_of(m.start()), "end_line": line_of(end_of(clean, m.end(), syntax.ends))})
    return facts


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def elixir_macros(text: str, clean: str, line_of, ends) -> Facts:
    """Fields with their resolvers and included scopes of a schema, tables, what names a table's module, and whole-module imports."""
    facts: Facts = []
    scopes = []
    for m in re.finditer(r"(?m)^[ \t]*(?:(query|mutation|subscription)|object\s*\(?\s*:(\w+))\b[^\n]*\bdo\b", clean):
        scopes.append((m.start(), ends(m.end() - 2), m[1] or m[2]))
    around = lambda at: next((s for a, b, s in reversed(scopes) if a <= at <= b), None)
    fields = [(m.start(), m[1]) for m in re.finditer(r"(?m)^[ \t]*field\s*\(?\s*:(\w+)", clean)]
    for i, (at, name) in enumerate(fields):
        scope = around(at)
        if scope is None:
            continue
        body = clean[at : fields[i + 1][0] if i + 1 < len(fields) else len(clean)]
        to = re.search(r"resolve\s*\(?\s*&([A-Z][\w.]*)\.(\w+[!?]?)/\d", body)
        facts.append({"fact": "provide", "transport": "Graphql", "method": scope, "path": _camel(name), "name": to and f"{to[1]}.{to[2]}", "start_line": line_of(at)})
    for m in re.finditer(r"(?m)^[ \t]*import_fields\s*\(?\s*:(\w+)", clean):
        if around(m.start()):
            facts.append({"fact": "include", "owner": around(m.start()), "name": m[1], "start_line": line_of(m.start())})
    for m in re.finditer(r"(?m)^[ \t]*schema\s+\"(\w+)\"\s+do", text):
        facts.append({"fact": "table", "name": m[1], "start_line": line_of(m.start())})
    for m in re.finditer(r"(?:\bRepo\.\w+[!?]?\(\s*|\bfrom\s*\(?\s*\w+\s+in\s+|%)([A-Z][\w.]*)", clean):
        facts.append({"fact": "entity", "name": m[1], "start_line": line_of(m.start(1))})
    for m in re.finditer(r"(?m)^[ \t]*import\s+([A-Z][\w.]*)", clean):
        facts.append({"fact": "star", "spec": m[1], "start_line": line_of(m.start())})
    return facts


_JS_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
SCRIPT = Syntax(
    line_comment=r"//[^\n]*",
    strings=_JS_STRINGS,
    defs=[
        ("Class", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"),
        ("Interface", r"^[ \t]*(?:export\s+)?interface\s+(?P<name>\w+)"),
        ("Enum", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"),
        ("Type", r"^[ \t]*(?:export\s+)?type\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*="),
        ("Function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"),
        ("Function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>"),
        ("Function", r"^[ \t]+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*\([^()\n]*\)\s*(?::[^{;\n]+)?\{"),
        ("Variable", r"^(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?="),
    ],
    imports=[
        r"^[ \t]*import\s+(?:type\s+)?(?:(?P<default>\w+)\s*,?\s*)?(?:\{(?P<names>[^}]*)\}|\*\s+as\s+(?P<whole>\w+))?\s*(?:from\s*)?['\"](?P<spec>[^'\"]+)['\"]",
        r"(?:const|let|var)\s+(?:\{(?P<names>[^}]*)\}|(?P<whole>\w+))\s*=\s*require\(\s*['\"](?P<spec>[^'\"]+)['\"]",
    ],
    reexports=[r"^[ \t]*export\s+(?:\{(?P<names>[^}]*)\}|\*)\s+from\s+['\"](?P<spec>[^'\"]+)['\"]"],
    exported=r"\bexport\b",
    binds=[r"(?:const|let|var)\s+(?P<name>\w+)\s*=\s*new\s+(?P<type>\w+)", r"[(,]\s*(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"(?:const|let|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)"],
    routes=[r"\b(?:app|router)\.(?P<verb>get|post|put|patch|delete)\(\s*['\"`](?P<path>/[^'\"`]*)['\"`]\s*,\s*(?P<handler>\w+)?"],
    requests=[
        r"\bfetch\(\s*['\"`](?P<path>[^'\"`]+)['\"`](?:\s*,\s*\{[^}]*?method\s*:\s*['\"](?P<verb>\w+)['\"])?",
        r"\baxios\.(?P<verb>get|post|put|patch|delete)\(\s*['\"`](?P<path>[^'\"`]+)['\"`]",
    ],
)
SYNTAX = {
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "elixir": Syntax(
        line_comment=r"#[^\n]*", block_comment=r'"""(?:.*?)"""', ends="end", exported=r"\b(?:def|defmodule|defmacro|defstruct)\b(?!p)", strings=r"\"(?:\\.|[^\"\\])*\"",
        defs=[("Module", r"^[ \t]*defmodule\s+(?P<name>[\w.]+)"), ("Function", r"^[ \t]*(?:def|defp|defmacro|defmacrop)\s+(?P<name>\w+[!?]?)")],
        imports=[r"^[ \t]*(?:alias|import|use|require)\s+(?P<spec>[A-Z][\w.]*)(?:\s*,\s*as:\s*(?P<whole>\w+))?"],
        routes=[r"^[ \t]*(?P<verb>get|post|put|patch|delete)\s+\"(?P<path>/[^\"]*)\"\s*,\s*\w+\s*,\s*:(?P<handler>\w+)"], macros=elixir_macros,
    ),
    "rust": Syntax(
        line_comment=r"//[^\n]*", strings=r"\"(?:\\.|[^\"\\])*\"", exported=r"\bpub\b", this=("self", "Self"), test_scope=r"#\[cfg\(test\)\]\s*mod\s+\w+",
        defs=[
            ("Class", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("Enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("Interface", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"),
            ("Module", r"^[ \t]*(?:pub\s+)?mod\s+(?P<name>\w+)\s*\{"), ("Type", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)[^{;]*\{"),
            ("Function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)"),
        ],
        imports=[r"^[ \t]*(?:pub\s+)?use\s+(?P<spec>[\w:]+?)(?:::\{(?P<names>[^}]*)\})?(?:\s+as\s+(?P<whole>\w+))?\s*;"],
        binds=[r"let\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)::", r"let\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*&?(?P<type>[A-Z]\w*)"],
    ),
    "go": Syntax(
        line_comment=r"//[^\n]*", strings=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", exported="upper",
        defs=[("Function", r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)"), ("Class", r"^type\s+(?P<name>\w+)\s+struct"), ("Interface", r"^type\s+(?P<name>\w+)\s+interface"), ("Type", r"^type\s+(?P<name>\w+)\s+[\w\[\]*.]+\s*$")],
        imports=[r"^import\s+(?P<whole>\w+)?\s*\"(?P<spec>[^\"]+)\"", r"^[ \t]+(?P<whole>\w+\s+)?\"(?P<spec>[\w./-]+)\"[ \t]*$"],
        binds=[r"(?P<name>\w+)\s*:=\s*&?(?P<type>[A-Z]\w*)\{", r"var\s+(?P<name>\w+)\s+\*?(?P<type>[A-Z]\w*)"],
    ),
    "gleam": Syntax(
        line_comment=r"//[^\n]*", exported=r"\bpub\b",
        defs=[("Function", r"^[ \t]*(?:pub\s+)?fn\s+(?P<name>\w+)"), ("Type", r"^[ \t]*(?:pub\s+)?(?:opaque\s+)?type\s+(?P<name>\w+)")],
        imports=[r"^import\s+(?P<spec>[\w/]+)(?:\.\{(?P<names>[^}]*)\})?(?:\s+as\s+(?P<whole>\w+))?"],
    ),
    "php": Syntax(
        line_comment=r"(?://|#(?!\[))[^\n]*", this=("$this", "self", "static", "this"),
        defs=[("Class", r"^[ \t]*(?:abstract\s+|final\s+)*class\s+(?P<name>\w+)"), ("Interface", r"^[ \t]*(?:interface|trait)\s+(?P<name>\w+)"), ("Function", r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)")],
        imports=[r"^[ \t]*use\s+(?P<spec>[\w\\]+)(?:\s+as\s+(?P<whole>\w+))?\s*;"],
        binds=[r"(?P<name>\$\w+)\s*=\s*new\s+(?P<type>\w+)"],
    ),
    "ruby": Syntax(
        line_comment=r"#[^\n]*", block_comment=r"^=begin.*?^=end", ends="end", this=("self",),
        defs=[("Class", r"^[ \t]*class\s+(?P<name>\w+)"), ("Module", r"^[ \t]*module\s+(?P<name>\w+)"), ("Function", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[!?=]?)")],
        imports=[r"^[ \t]*(?:require|require_relative|gem)\s*\(?\s*['\"](?P<spec>[^'\"]+)['\"]"],
        binds=[r"^[ \t]*(?P<name>\w+)\s*=\s*(?P<type>[A-Z]\w*)\.new"],
    ),
}


def _adapter(syntax: Syntax):
    return lambda module_path, text: scan(text, syntax)


for _language, _syntax in SYNTAX.items():
    register(_language)(_adapter(_syntax))
