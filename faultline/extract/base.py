"""Adapters, and the table-valued function that runs them over files.

Every adapter turns one text into facts; a fact is a dict with ``fact`` (def, import,
reexport, ref, bind, test_scope, provide, consume) and some of the columns of FACTS. Adapters
are looked up by language and can be replaced or added with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

Facts = list[dict]
Adapter = Callable[[str, str], Facts]
ADAPTERS: dict[str, Adapter] = {}

FACTS = (
    "fact string, module_path string, root string, language string, ord int, name string, qualified_name string, kind string, owner string, "
    "start_line int, end_line int, col int, is_exported boolean, doc string, spec string, imported string, local string, qualifier string, "
    "recv_kind string, recv_text string, type string, scope_start int, scope_end int, transport string, method string, path string"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def register(language: str) -> Callable[[Adapter], Adapter]:
    def add(adapter: Adapter) -> Adapter:
        ADAPTERS[language] = adapter
        return adapter

    return add


def facts_of(language: str, module_path: str, text: str) -> Facts:
    """The facts of one text; a text that its adapter can't read has none."""
    from . import brackets, graphql, markup, python_code  # noqa: F401  (they register themselves)

    adapter = ADAPTERS.get(language)
    if adapter is None:
        return []
    try:
        return adapter(module_path, text)
    except (SyntaxError, ValueError, RecursionError):
        return []


def capabilities() -> list[tuple[str, bool, bool, bool]]:
    """(language, has imports, has references, has bindings)."""
    from . import brackets, graphql, markup, python_code  # noqa: F401

    plain = {"graphql", "html"}
    return [(lang, lang not in plain, lang not in plain, lang in ("python", "typescript", "tsx", "svelte", "vue", "go", "rust")) for lang in sorted(ADAPTERS)]


def extract(files: DataFrame) -> DataFrame:
    """All facts of files (module_path, root, language, content): one pass over each text, dealt by size of the partitions."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for module, root, lang, content in zip(b.module_path, b.root, b.language, b.content, strict=True):
                for i, f in enumerate(facts_of(lang, module, bytes(content).decode("utf-8", "replace"))):
                    rows.append({"module_path": module, "root": root, "language": lang, "ord": i} | f)
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c, t in (x.split() for x in FACTS.split(", ")):
                out[c] = out[c].astype({"int": "Int32", "boolean": "boolean"}.get(t, "object"))
            yield out.where(out.notna(), None)

    return files.select("module_path", "root", "language", "content").mapInPandas(run, FACTS)


def of(facts: DataFrame, fact: str, *columns: str) -> DataFrame:
    return facts.filter(facts["fact"] == fact).select(*columns)
