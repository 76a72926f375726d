"""Configuration files: tsconfig, package.json, go.mod, API specifications."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    parts = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|/', text, re.S)
    bare = [p if p.startswith('"') else "" if p.startswith(("//", "/*")) else p for p in parts]
    joined = "".join(bare)
    out, at = [], 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', joined):
        if m[0] == ",":
            out.append(joined[at : m.start()])
            at = m.end()
    return "".join(out) + joined[at:]


def tsconfig_paths(content: str) -> list[tuple[str, str, int, str]]:
    """(pattern, target, ord, base_url) of a tsconfig, in the order they are tried."""
    options = (json.loads(strip_jsonc(content)) or {}).get("compilerOptions") or {}
    base, out = options.get("baseUrl", "."), []
    for pattern, targets in (options.get("paths") or {}).items():
        out += [(pattern, t, len(out) + i, base) for i, t in enumerate(targets)]
    return out


def path_aliases(files: DataFrame) -> DataFrame:
    """dir, pattern, target, ord, base_url of every tsconfig.json or jsconfig.json; base_url is counted from the top."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.module_path, b.content, strict=True):
                folder = path.rpartition("/")[0]
                try:
                    found = tsconfig_paths(bytes(content).decode("utf-8", "replace"))
                except (ValueError, AttributeError):
                    continue
                out += [(folder, p, t, o, f"{folder}/{base}" if folder else base) for p, t, o, base in found]
            yield pd.DataFrame(out, columns=["dir", "pattern", "target", "ord", "base_url"])

    own = files.filter(F.col("module_path").rlike(r"(^|/)[tj]sconfig[^/]*\.json$")).select("module_path", "content")
    return own.mapInPandas(run, "dir string, pattern string, target string, ord int, base_url string")


def package_dirs(files: DataFrame) -> DataFrame:
    """name, dir of every package.json (module_path, content)."""
    own = files.filter(F.col("module_path").rlike(r"(^|/)package\.json$"))
    name = F.get_json_object(F.col("content").cast("string"), "$.name")
    return own.select(name.alias("name"), F.regexp_replace("module_path", r"/?package\.json$", "").alias("dir")).filter("name IS NOT NULL")


def go_modules(files: DataFrame) -> DataFrame:
    """module, dir of every go.mod."""
    own = files.filter(F.col("module_path").rlike(r"(^|/)go\.mod$"))
    module = F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1)
    return own.select(module.alias("module"), F.regexp_replace("module_path", r"/?go\.mod$", "").alias("dir")).filter("module <> ''")


def shared_packages(packages: DataFrame) -> DataFrame:
    """root, name, home: packages declared in exactly one root, as the other roots see them. packages: root, name."""
    own = packages.select("root", "name").distinct()
    once = own.groupBy("name").agg(F.count("*").alias("n"), F.min("root").alias("home")).filter("n = 1").drop("n")
    return own.select("root").distinct().join(once, F.col("root") != F.col("home")).select("root", "name", "home")


def visible_packages(packages: DataFrame) -> DataFrame:
    """name, dir, root: every package as each root sees it, its own ones and those that only one other root declares. packages: name, dir, root."""
    shared = shared_packages(packages).join(packages.select("name", "dir", F.col("root").alias("home")), ["name", "home"])
    return packages.select("name", "dir", "root").unionByName(shared.select("name", "dir", "root"))


def looks_like_spec(text: str) -> bool:
    return any(re.match(r'\s*["\']?(openapi|swagger)["\']?\s*:', line) for line in text.splitlines()[:40])


def spec_routes(text: str) -> list[tuple[str, str]]:
    """(METHOD, path) of an OpenAPI or Swagger document, JSON or (where a parser is there) YAML."""
    if not looks_like_spec(text):
        return []
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            return []
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError:
            return []
    if not isinstance(doc, dict) or not isinstance(doc.get("paths"), dict):
        return []
    base = str(doc.get("basePath") or "").rstrip("/")
    return [(verb.upper(), base + path) for path, item in doc["paths"].items() if isinstance(item, dict) for verb in item if verb in VERBS]


def read_specs(files: DataFrame) -> DataFrame:
    """module_path, method, path of every API specification among files (module_path, content)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(m, v, p) for m, c in zip(b.module_path, b.content, strict=True) for v, p in spec_routes(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(out, columns=["module_path", "method", "path"])

    own = files.filter(F.col("module_path").rlike(r"\.(json|ya?ml)$")).select("module_path", "content")
    return own.mapInPandas(run, "module_path string, method string, path string")
