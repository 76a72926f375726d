"""GraphQL documents: operations, fragments and every selection path; and the fields of a schema's types."""

from __future__ import annotations

import re

from .base import Facts, register

_TOKEN = re.compile(r'#[^\n]*|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\.\.\.|[A-Za-z_]\w*|[{}()\[\]:!=@|&$]|-?\d[\d.]*')


#: What begins a definition of a schema.
SCHEMA_WORDS = ("schema", "type", "interface", "input", "enum", "union", "scalar", "directive", "extend")
ROOTS = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}


def schema_fields(text: str) -> list[tuple[str, str, str, int]]:
    """(type, field, type it returns, line) of the object types and interfaces of a schema."""
    bare = re.sub(r'#[^\n]*|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for t in re.finditer(r"(?m)^[ \t]*(?:extend\s+)?(?:type|interface)\s+(\w+)[^{}]*\{([^{}]*)\}", bare):
        for f in re.finditer(r"(\w+)\s*(?:\([^)]*\))?\s*:\s*[\[\s]*(\w+)", re.sub(r"\([^)]*\)", lambda m: re.sub(r"[^\n]", " ", m[0]), t[2])):
            out.append((t[1], f[1], f[2], bare.count("\n", 0, t.start(2) + f.start()) + 1))
    return out


def document(text: str) -> tuple[list[dict], list[dict]]:
    """(operations and fragments, selections): a selection has owner, path (a list) and, for a spread, fragment."""
    tokens = [(m[0], m.start()) for m in _TOKEN.finditer(text) if not m[0].startswith(("#", '"'))]
    heads, selections, i = [], [], 0
    line = lambda k: text.count("\n", 0, tokens[min(k, len(tokens) - 1)][1]) + 1

    def skip(k: int, opening: str, closing: str) -> int:
        depth = 0
        while k < len(tokens):
            depth += (tokens[k][0] == opening) - (tokens[k][0] == closing)
            k += 1
            if not depth:
                return k
        return k

    def selection_set(k: int, owner: str, path: list[str]) -> int:
        k += 1
        while k < len(tokens) and tokens[k][0] != "}":
            t = tokens[k][0]
            if t == "...":
                k += 1
                if k < len(tokens) and tokens[k][0] == "on":
                    k += 2
                elif k < len(tokens) and tokens[k][0] not in "{@":
                    selections.append({"owner": owner, "path": path, "fragment": tokens[k][0]})
                    k += 1
            elif re.match(r"[A-Za-z_]", t):
                k += 1
                if k + 1 < len(tokens) and tokens[k][0] == ":":
                    t = tokens[k + 1][0]
                    k += 2
                if k < len(tokens) and tokens[k][0] == "(":
                    k = skip(k, "(", ")")
                selections.append({"owner": owner, "path": [*path, t], "fragment": None})
                path_here = [*path, t]
                while k < len(tokens) and tokens[k][0] == "@":
                    k += 2
                    if k < len(tokens) and tokens[k][0] == "(":
                        k = skip(k, "(", ")")
                if k < len(tokens) and tokens[k][0] == "{":
                    k = selection_set(k, owner, path_here)
                continue
            else:
                k += 1
                continue
            while k < len(tokens) and tokens[k][0] == "@":
                k += 2
                if k < len(tokens) and tokens[k][0] == "(":
                    k = skip(k, "(", ")")
            if k < len(tokens) and tokens[k][0] == "{":
                k = selection_set(k, owner, path)
        return k + 1

    while i < len(tokens):
        t = tokens[i][0]
        if t in SCHEMA_WORDS:
            # A definition of the schema, up to the end of its body if it has one.
            i += 1
            while i < len(tokens) and tokens[i][0] not in SCHEMA_WORDS and tokens[i][0] not in ("query", "mutation", "subscription", "fragment", "{"):
                i += 1
            if i < len(tokens) and tokens[i][0] == "{":
                i = skip(i, "{", "}")
        elif t in ("query", "mutation", "subscription", "fragment") or t == "{":
            start, name, scope = i, "", "query" if t == "{" else t
            j = i if t == "{" else i + 1
            if t != "{" and j < len(tokens) and re.match(r"[A-Za-z_]", tokens[j][0]):
                name = tokens[j][0]
                j += 1
            while j < len(tokens) and tokens[j][0] != "{":
                j = skip(j, "(", ")") if tokens[j][0] == "(" else j + 1
            end = selection_set(j, name, []) if j < len(tokens) else j
            heads.append({"name": name, "scope": scope, "start_line": line(start), "end_line": line(end - 1)})
            i = end
        else:
            i += 1
    return heads, selections


@register("graphql")
def graphql(module_path: str, text: str) -> Facts:
    heads, selections = document(text)
    facts: Facts = [{"fact": "def", "name": h["name"], "qualified_name": h["name"], "kind": "Function", "owner": h["scope"], "start_line": h["start_line"], "end_line": h["end_line"], "col": 1, "is_exported": True} for h in heads if h["name"]]
    scope = {h["name"]: h["scope"] for h in heads}
    for s in selections:
        if s["fragment"]:
            facts.append({"fact": "spread", "owner": s["owner"], "name": s["fragment"]})
        else:
            facts.append({"fact": "consume", "transport": "Graphql", "method": scope.get(s["owner"]), "owner": s["owner"], "path": "/".join(s["path"])})
    for t, field, returns, line in schema_fields(text):
        facts.append({"fact": "def", "name": field, "qualified_name": f"{t}.{field}", "kind": "Field", "owner": t, "start_line": line, "end_line": line, "col": 1, "is_exported": True})
        facts.append({"fact": "provide", "transport": "Graphql", "method": ROOTS.get(t, t), "owner": t, "path": field, "type": returns, "start_line": line})
    return facts
