"""Fixed values of the model: vocabularies, weights, confidences and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much of an effect crosses an edge of each kind; any other kind weighs OTHER_WEIGHT.
KIND_WEIGHTS = {
    "Calls": 1.0, "GraphqlCall": 1.0, "HttpCall": 1.0,
    "References": 0.9, "DbQuery": 0.9, "Implements": 0.9, "Extends": 0.9, "Serves": 0.9,
    "Imports": 0.7, "ChangesWith": 0.6,
}
OTHER_WEIGHT = 0.5
DECAY, EPSILON, MAX_ROUNDS = 0.85, 0.02, 24

# Base confidences of links.
CONF_IMPORT, CONF_LOCAL_CALL, CONF_KNOWN_RECEIVER, CONF_TYPED_RECEIVER = 0.95, 0.95, 0.9, 0.85
CONF_BY_NAME_MEMBER, CONF_QUALIFIED_OWNER, CONF_QUALIFIED_NAME, QUALIFIED_NAME_CAP = 0.6, 0.9, 0.75, 4
CONF_GRAPHQL, CONF_CONTEXT_MODULE, CONF_QUALIFIED_CALL, CONF_DB, CONF_STAR, CONF_ENDPOINT, CONF_SERVES = 0.9, 0.5, 0.9, 0.85, 0.9, 0.9, 0.9
CROSS_ROOT, TEST_EDGE, NORMALIZED_ROUTE, SERVER_ONLY, CONTRADICTED_FLOOR = 0.85, 0.8, 0.9, 0.7, 0.4

# Limits of the history that is mined and of the coupling that is kept.
COMMIT_WINDOW, MAX_FILES_PER_COMMIT, MIN_SHARED, MIN_COUPLING = 3000, 40, 2, 0.3
MAX_REEXPORT_HOPS, MAX_FRAGMENT_HOPS, MAX_RENAME_HOPS, MAX_ROUTES = 4, 4, 16, 2000
RISK_WEIGHTS = {"churn": 0.0, "bug_density": 0.0, "ownership": 0.0, "fanout": 1.0}
CALL_KINDS = ("Calls", "AsyncCall", "References")
CONTAINER_KINDS = ("Function", "Method", "Class", "Module", "Component")

# Directories that are never indexed (".faultline" is this engine's own).
IGNORED_DIRS = (
    "node_modules deps vendor site-packages .venv venv _build dist build out target .next __pycache__ .mypy_cache .pytest_cache "
    ".tox coverage cover .git .faultline .dexter .elixir_ls .lexical .expert .bsp .claude"
).split()

# File suffixes of each language, in order of registration.
LANGUAGES = {
    "typescript": [".ts", ".mts", ".cts"],
    "tsx": [".tsx", ".jsx", ".js", ".mjs", ".cjs"],
    "elixir": [".ex", ".exs"],
    "graphql": [".graphql", ".gql"],
    "rust": [".rs"],
    "go": [".go"],
    "gleam": [".gleam"],
    "python": [".py"],
    "html": [".html", ".htm"],
    "php": [".php"],
    "ruby": [".rb"],
    "svelte": [".svelte"],
    "vue": [".vue"],
}

# Task words that are not looked for.
STOPWORDS = (
    "a an the to of in on at by for and or as is are be it its this that with into from after before when where how what "
    "which then than so if no not implement please"
).split()

# Message parts that mark a fix.
FIX_WORDS = ("fix", "bug", "revert", "hotfix", "patch", "regression")

# What a test file's path looks like, by language.
TEST_PATHS = {
    "typescript": r"(\.test\.|\.spec\.)[^/]*$|(^|/)(__tests__|test|tests|spec)/",
    "tsx": r"(\.test\.|\.spec\.)[^/]*$|(^|/)(__tests__|test|tests|spec)/",
    "python": r"(^|/)test_[^/]*$|_test\.py$|(^|/)tests/",
    "elixir": r"_test\.exs$|(^|/)test/",
    "go": r"_test\.go$",
    "ruby": r"(_spec|_test)\.rb$|(^|/)(spec|test)/",
    "rust": r"(^|/)tests/",
    "gleam": r"_test\.gleam$|(^|/)test/",
}


def kind_weight(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, w in KIND_WEIGHTS.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return F.coalesce(out, F.lit(OTHER_WEIGHT))


def kind_weight_sql(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN CAST({w} AS DOUBLE)" for k, w in KIND_WEIGHTS.items()) + f" ELSE CAST({OTHER_WEIGHT} AS DOUBLE) END"
