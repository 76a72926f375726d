"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IGNORED_DIRS, LANGUAGES, STOPWORDS, TEST_PATHS


def split_words(s: Column) -> Column:
    """Lower-case words of an identifier or a sentence; a hump starts a word only after a lower-case letter."""
    humps = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(humps), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def singular(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, 100000).substr(F.lit(1), F.length(w) - 1)).otherwise(w)


def tokenize(s: Column) -> Column:
    """Words in the singular, as they are matched."""
    return F.transform(split_words(s), singular)


def is_signal(w: Column) -> Column:
    return (F.length(w) >= 2) & ~w.isin(*STOPWORDS)


def task_terms(task: str) -> Column:
    """Array of struct(term, raw) of a task text; a stem that comes twice counts once, under its first spelling."""
    words = F.filter(split_words(F.lit(task)), is_signal)
    terms = F.transform(words, lambda w: F.struct(singular(w).alias("term"), w.alias("raw")))
    first = lambda t, i: ~F.exists(F.slice(terms, 1, i), lambda o: o["term"] == t["term"])
    return F.filter(terms, first)


def search_terms(q: Column) -> Column:
    return F.filter(F.split(F.lower(q), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def identifier_tokens(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9_]{3,}"), F.lit(0)))


def path_segments(path: Column) -> Column:
    """Segments of an HTTP path: ':' for a parameter (:x or {x}), '*' for a rest (*x), else the literal."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.startswith(":") | (p.startswith("{") & p.endswith("}")), F.lit(":")).when(p.startswith("*"), F.lit("*")).otherwise(p))


def url_template(url: Column) -> Column:
    """A template literal with its ${...} parts as path parameters, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"\$\{[^}]*\}", "/:param/"), r"[?#].*$", ""), r"/+", "/")


def literal_share(segments: Column) -> Column:
    literal = F.size(F.filter(segments, lambda s: ~s.isin(":", "*")))
    return F.when(F.size(segments) == 0, F.lit(1.0)).otherwise(literal / F.size(segments))


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^:.]*)$", 1)


def camelize(s: Column) -> Column:
    """snake_case to camelCase."""
    parts = F.split(s, "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))), ""))


def decamelize(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def operation_key(s: Column) -> Column:
    return F.concat(F.upper(s.substr(1, 1)), s.substr(F.lit(2), F.length(s)))


def bare_name(spelling: Column) -> Column:
    """The name before arity or arguments, without its owner: 'Mod.fun/2' and 'fun(a)' give 'fun'."""
    return last_segment(F.regexp_replace(spelling, r"[/(].*$", ""))


def is_ignored(path: Column) -> Column:
    """Whether a directory of the path (not the file itself) is never indexed; by exact name."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for lang, suffixes in reversed(list(LANGUAGES.items())):
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | path.endswith(s)
        out = F.when(hit, F.lit(lang)).otherwise(out)
    return out


def is_test_path(path: Column, language: Column) -> Column:
    out = F.lit(False)
    for lang, pattern in TEST_PATHS.items():
        out = F.when(language == lang, path.rlike(pattern)).otherwise(out)
    return out


def dependency_key(spec: Column, ecosystem: Column) -> Column:
    """The package that an import of something outside the tree names; null for relative or standard imports."""
    relative = spec.startswith(".") | spec.startswith("/") | (spec == "")
    first = F.element_at(F.split(spec, "/"), 1)
    blank = lambda c: F.when(c != "", c)
    npm = F.when(spec.startswith("@"), blank(F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1))).otherwise(blank(first))
    php = blank(F.element_at(F.split(F.regexp_replace(spec, r"^\\+", ""), r"\\"), 1))
    return (
        F.when(ecosystem == "php", php)
        .when(relative, F.lit(None).cast("string"))
        .when(ecosystem == "npm", npm)
        .when(ecosystem == "python", blank(F.element_at(F.split(spec, r"\."), 1)))
        .when(ecosystem == "go", F.when(first.contains("."), spec))
        .when(ecosystem == "ruby", blank(first))
    )


def predicate(name: str, value: Column, *wanted: str) -> Column:
    """A condition of a capture by its name: eq?, not-eq?, any-of?, not-any-of?, match? or not-match?."""
    plain = name.removeprefix("not-")
    if plain == "match?":
        out = value.rlike(wanted[0])
    elif plain in ("eq?", "any-of?"):
        out = value.isin(*wanted)
    else:
        raise ValueError(f"no such predicate: {name}")
    return ~out if name.startswith("not-") else out
