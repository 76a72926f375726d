"""Python, by its own parser."""

from __future__ import annotations

import ast

from .base import Facts, register

DOC_LENGTH = 400


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


class _Reader(ast.NodeVisitor):
    def __init__(self, lines: int):
        self.facts: Facts = []
        self.owner: list[str] = []
        self.in_class: list[str | None] = [None]
        self.scope = [(1, max(1, lines))]

    def _def(self, node, kind: str) -> None:
        q = ".".join([*self.owner, node.name])
        doc = ast.get_docstring(node)
        self.facts.append({
            "fact": "def", "name": node.name, "qualified_name": q, "kind": kind, "owner": self.in_class[-1], "start_line": node.lineno, "end_line": node.end_lineno, "col": node.col_offset + 1,
            "is_exported": not node.name.startswith("_") and len(self.owner) <= 1, "doc": doc[:DOC_LENGTH] if doc else None,
        })

    def visit_FunctionDef(self, node) -> None:  # noqa: N802
        self._def(node, "Method" if self.in_class[-1] else "Function")
        for d in node.decorator_list:
            self.visit(d)
            self._route(d, node)
        self.owner.append(node.name)
        self.in_class.append(None)
        self.scope.append((node.lineno, node.end_lineno))
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None:
                self._bind(a.arg, node.lineno, _dotted(a.annotation) or "")
            elif a.arg not in ("self", "cls"):
                self._bind(a.arg, node.lineno, "")
        for x in [*node.args.defaults, *filter(None, node.args.kw_defaults), *node.body]:
            self.visit(x)
        self.owner.pop()
        self.in_class.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node) -> None:  # noqa: N802
        self._def(node, "Class")
        self.owner.append(node.name)
        self.in_class.append(node.name)
        self.generic_visit(node)
        self.owner.pop()
        self.in_class.pop()

    def _bind(self, name: str, line: int, type_: str) -> None:
        a, b = self.scope[-1]
        self.facts.append({"fact": "bind", "name": name, "start_line": line, "type": type_.rpartition(".")[2], "scope_start": a, "scope_end": b})

    def _assigned(self, target, value, line: int, annotation=None) -> None:
        if not isinstance(target, ast.Name):
            return
        made = _dotted(value.func) if isinstance(value, ast.Call) else None
        type_ = _dotted(annotation) if annotation is not None else made if made and made.rpartition(".")[2][:1].isupper() else ""
        if self.owner:
            self._bind(target.id, line, type_ or "")
        else:
            self.facts.append({"fact": "def", "name": target.id, "qualified_name": target.id, "kind": "Variable", "owner": None, "start_line": line, "end_line": getattr(value, "end_lineno", line) or line, "col": target.col_offset + 1, "is_exported": not target.id.startswith("_")})
            self._bind(target.id, line, type_ or "")

    def visit_Assign(self, node) -> None:  # noqa: N802
        for t in node.targets:
            self._assigned(t, node.value, node.lineno)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:  # noqa: N802
        self._assigned(node.target, node.value, node.lineno, node.annotation)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:  # noqa: N802
        for a in node.names:
            self.facts.append({"fact": "import", "spec": a.name, "imported": "*", "local": a.asname or a.name.split(".")[0], "start_line": node.lineno, "end_line": node.end_lineno})

    def visit_ImportFrom(self, node) -> None:  # noqa: N802
        spec = "." * node.level + (node.module or "")
        for a in node.names:
            self.facts.append({"fact": "import", "spec": spec, "imported": a.name, "local": a.asname or a.name, "start_line": node.lineno, "end_line": node.end_lineno})

    def visit_Call(self, node) -> None:  # noqa: N802
        f = node.func
        at = {"fact": "ref", "start_line": node.lineno, "col": node.col_offset + 1}
        if isinstance(f, ast.Name):
            self.facts.append(at | {"name": f.id})
        elif isinstance(f, ast.Attribute):
            v, whole = f.value, _dotted(f.value)
            if whole in ("self", "cls"):
                kind, text = "this", whole
            elif isinstance(v, ast.Call) and (made := _dotted(v.func)) and made.rpartition(".")[2][:1].isupper():
                kind, text = "new", made.rpartition(".")[2]
            elif isinstance(v, ast.Name):
                kind, text = "ident", v.id
            else:
                kind, text = "other", whole
            self.facts.append(at | {"name": f.attr, "recv_kind": kind, "recv_text": text})
            self._request(f.attr, text, node)
        self.generic_visit(node)

    def _request(self, verb: str, client: str | None, node) -> None:
        if verb in ("get", "post", "put", "patch", "delete") and client in ("requests", "httpx", "client", "session") and node.args:
            url = node.args[0]
            if isinstance(url, ast.Constant) and isinstance(url.value, str):
                self.facts.append({"fact": "consume", "transport": "Http", "method": verb.upper(), "path": url.value, "start_line": node.lineno})

    def _route(self, decorator, node) -> None:
        if isinstance(decorator, ast.Call) and isinstance(decorator.func, ast.Attribute) and decorator.args:
            verb, path = decorator.func.attr, decorator.args[0]
            if verb in ("get", "post", "put", "patch", "delete", "route") and isinstance(path, ast.Constant) and isinstance(path.value, str):
                self.facts.append({"fact": "provide", "transport": "Http", "method": None if verb == "route" else verb.upper(), "path": path.value, "name": node.name, "start_line": node.lineno})


@register("python")
def python(module_path: str, text: str) -> Facts:
    reader = _Reader(text.count("\n") + 1)
    reader.visit(ast.parse(text))
    return reader.facts
