"""Components and pages: their script is read as TypeScript, in the coordinates of the file."""

from __future__ import annotations

import re

from .base import Facts, register
from .brackets import SCRIPT, scan


def script_only(text: str) -> str:
    """The text with everything outside <script> blanked, so lines and columns stay."""
    out, at = [], 0
    for m in re.finditer(r"<script\b(?P<attrs>[^>]*)>(?P<body>.*?)</script>", text, re.S | re.I):
        if re.search(r"type\s*=\s*[\"'](?!module|text/(java|type)script)", m["attrs"], re.I):
            continue
        out.append(re.sub(r"[^\n]", " ", text[at : m.start("body")]))
        out.append(m["body"])
        at = m.end("body")
    return "".join(out) + re.sub(r"[^\n]", " ", text[at:])


def _component(module_path: str, text: str) -> Facts:
    name = re.sub(r"\.[^.]*$", "", module_path.rsplit("/", 1)[-1])
    whole = {"fact": "def", "name": name, "qualified_name": name, "kind": "Component", "owner": None, "start_line": 1, "end_line": text.count("\n") + 1, "col": 1, "is_exported": True}
    return [whole, *scan(script_only(text), SCRIPT)]


register("svelte")(_component)
register("vue")(_component)


@register("html")
def html(module_path: str, text: str) -> Facts:
    return scan(script_only(text), SCRIPT)
