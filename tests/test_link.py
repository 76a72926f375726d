"""The linker where references repeat and where definitions and spans are many."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.operators import link
from faultline.plans import catalog, catalog_link  # noqa: F401  (registers into the first)

DEFS = "key string, root string, module_path string, name string, owner string, kind string"
REFS = "ref long, root string, module_path string, name string, qualifier string, src string, line int"


def against_sql(spark, tmp_path, name, **tables):
    """Query and SQL of a name over tables (columns and rows); both sorted."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, out = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.SQL[name])
    return (sorted((tuple(r[c] for c in out.columns) for r in df.collect()), key=repr), sorted(out.fetchall(), key=repr))


#: Rows that repeat (l_orderkey, l_linenumber) with other parts: brand and name of 3, 2 and 1 definitions, in one type and in two.
PART = ("p_partkey long, p_name string, p_brand string, p_type string", [(0, "red nut", "B1", "T"), (1, "red nut", "B1", "T"), (2, "red nut", "B1", "U"), (3, "hot nut", "B1", "T"), (4, "hot nut", "B1", "T"), (5, "big nut", "B2", "U"), (11, "hot nut", "B3", "U"), (6, "odd nut", "B1", "T")])
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
REPEATED = (LINES, [(0, 0, 1, 1), (0, 3, 2, 1), (5, 0, 3, 1), (10, 3, 4, 1), (10, 5, 4, 1), (15, 0, 1, 3), (15, 11, 1, 3), (20, 5, 5, 2), (20, 0, 0, 2), (25, 6, 9, 1), (30, 0, 7, 1), (30, 0, 7, 1), (35, 3, 3, 4), (35, 3, 3, 4), (35, 3, 3, 4), (40, 0, 1, 3), (40, 6, 1, 3)])


def test_qualified_calls_of_repeated_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "d14_qualified_calls", part=PART, lineitem=REPEATED)
    assert got == want and {r[3] for r in want} == {1, 2, 3}


def test_qualified_calls_count_over_the_reference(spark):
    defs = spark.createDataFrame([(f"d{i}", "r", "m", "three" if i < 3 else "two", None, "Function") for i in range(5)], DEFS)
    refs = spark.createDataFrame([(1, "r", "m", "three", "x", "s", 1), (1, "r", "m", "two", "x", "s", 1), (2, "r", "m", "three", "x", "s", 1), (3, "r", "m", "three", "X", "s", 1)], REFS)
    got = link.qualified_calls(refs, defs).select("ref", "dst", "rule_no").collect()
    assert sorted(map(tuple, got), key=repr) == [(2, "d0", 3), (2, "d1", 3), (2, "d2", 3), (3, None, 2)]


def exchanges_above_pairs(plan, pairs):
    """Exchanges of a plan that stand above its last join, whose output is pairs."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    return text[: text.index(pairs)].count("Exchange ")


def test_bare_calls_of_repeated_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "d13_bare_calls", part=PART, lineitem=REPEATED)
    assert got == want and want


def test_bare_calls_move_no_pairs(spark):
    defs = spark.createDataFrame([("a", "r", "m", "x", None, "Function"), ("b", "r", "m", "x", None, "Function"), ("f", "r", "m", "y", None, "Field")], DEFS)
    imported = spark.createDataFrame([("m", "x", "i"), ("m", "y", "j"), ("m", "y", "k")], "module_path string, local string, key string")
    refs = spark.createDataFrame([(1, "r", "m", "x", None, "s", 1), (2, "r", "m", "y", None, "s", 1), (3, "r", "m", "x", None, "s", 1), (3, "r", "m", "y", None, "s", 1), (4, "r", "m", "z", None, "s", 1)], REFS)
    out = link.bare_calls(refs, defs, imported).select("ref", "dst", "rule_no")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "b", 1), (2, "j", 2), (2, "k", 2), (3, "a", 1), (3, "b", 1)]
    assert exchanges_above_pairs(out, "Join") == 0


def test_bare_calls_come_in_runs(spark):
    defs = spark.createDataFrame([(f"d{i}", "r", "m", "x", None, "Function") for i in range(40)], DEFS)
    refs = spark.createDataFrame([(i if i else None, "r", "m", "x", None, "s", 1) for i in range(600)] + [(9, "r", "m", "x", None, "s", 1)], REFS)
    imported = spark.createDataFrame([], "module_path string, local string, key string")
    got = [r.dst for r in link.bare_calls(refs, defs, imported).collect()]
    assert len(got) == 601 * 40 and set(got) == {f"d{i}" for i in range(40)}
    # A definition stays for a block of references: 601 of them are three blocks, in as many parts at most.
    assert sum(a != b for a, b in zip(got, got[1:])) < 40 * 6


@pytest.mark.parametrize("pairs", [1, 1000, 1 << 23])
def test_bare_calls_of_names_in_parts(spark, monkeypatch, pairs):
    monkeypatch.setattr(link, "PART_PAIRS", pairs)
    monkeypatch.setattr(link, "BLOCK", 16)
    rng = random.Random(5)
    defs = [(f"d{i}", "r", "mn"[i % 2], rng.choice("xyz"), None, rng.choice(["Function", "Field"])) for i in range(60)]
    refs = [(rng.randrange(700) or None, "r", rng.choice("mn"), rng.choice("xyzw"), None, "s", 1) for _ in range(900)]
    bound = [("m", "x", "i"), ("n", "w", "j"), ("n", "w", "k")]
    rules = lambda m, n: ([d[0] for d in defs if d[2:4] == (m, n) and d[5] != "Field"], [k for a, b, k in bound if (a, b) == (m, n)])
    met = [(r[0], k, no) for r in refs for no, keys in enumerate(rules(r[2], r[3]), 1) for k in keys]
    want = [x for x in met if x[2] == min(y[2] for y in met if y[0] == x[0])]
    out = link.bare_calls(spark.createDataFrame(refs, REFS), spark.createDataFrame(defs, DEFS), spark.createDataFrame(bound, "module_path string, local string, key string"))
    assert sorted(map(tuple, out.select("ref", "dst", "rule_no").collect()), key=repr) == sorted(want, key=repr)


def test_call_edges_of_repeated_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "d19_call_edges", part=PART, lineitem=REPEATED)
    assert got == want and want


def test_call_edges_of_keys_under_several_names(spark, tmp_path):
    schema, parts = PART
    got, want = against_sql(spark, tmp_path, "d19_call_edges", part=(schema, parts + [(0, "hot nut", "B1", "T"), (0, "red nut", "B1", "T"), (3, "odd nut", "B1", "T"), (5, "hot nut", "B1", "T")]), lineitem=REPEATED)
    assert got == want and want


def test_call_edges_move_no_pairs(spark):
    defs = spark.createDataFrame([(f"d{i}", "r", "m", "xy"[i % 2], None, "Function") for i in range(5)] + [("e", "r", "m", "x", None, "Method"), ("e", "r", "m", "y", None, "Method")], DEFS)
    refs = spark.createDataFrame([(1, "r", "m", "x", None, "s", 1), (2, "r", "m", "x", None, "s", 1), (3, "r", "m", "x", None, "d0", 2), (3, "r", "m", "y", None, "s", 2)], REFS)
    out = link.named_call_edges(refs, defs, ["root", "name"], 0.6)
    hits = refs.join(defs.select("root", "name", "key"), ["root", "name"]).selectExpr("ref", "key AS dst", "0.6D AS base")
    want = link.call_edges(hits, refs).selectExpr("src", "dst", "line", "round(confidence, 6) AS confidence").groupBy("src", "dst", "line", "confidence").count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    # The final one after the union counts sites of the shared key alone; pairs of single keys go out from their join.
    plan = out.filter("dst <> 'e'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_call_edges_come_in_runs(spark):
    defs = spark.createDataFrame([(f"d{i}", "r", "m", "x", None, "Function") for i in range(40)], DEFS)
    refs = spark.createDataFrame([(i, "r", "m", "x", None, f"s{i % 500}", 1) for i in range(600)], REFS)
    got = link.named_call_edges(refs, defs, ["root", "name"], 0.6).collect()
    assert len(got) == 500 * 40 and sum(r.sites for r in got) == 600 * 40 and {r.confidence for r in got} == {0.015}
    assert sum(a.dst != b.dst for a, b in zip(got, got[1:])) < 40 * 6


@pytest.mark.parametrize("small_rows", [0, 10_000])
def test_call_edges_of_names_in_parts(spark, tmp_path, monkeypatch, small_rows):
    monkeypatch.setattr(link, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(link, "PART_PAIRS", 50)
    monkeypatch.setattr(link, "BLOCK", 4)
    rng = random.Random(3)
    parts = [(rng.randrange(90), rng.choice(["red", "hot", "big"]), rng.choice(["B1", "B2"]), "T") for _ in range(100)]
    lines = [(5 * rng.randrange(60), rng.randrange(90), rng.randrange(40), rng.randrange(1, 4)) for _ in range(300)]
    got, want = against_sql(spark, tmp_path, "d19_call_edges", part=(PART[0], parts), lineitem=(LINES, lines))
    assert got == want and want


def placed(spark, spans, points, innermost):
    out = link.enclosing(spark.createDataFrame(points, "id long, module_path string, line int"), spark.createDataFrame(spans, "module_path string, key string, start_line int, end_line int"), "id", innermost)
    return {r.id: r.container for r in out.collect()}


def test_enclosing_against_all_pairs(spark):
    rng = random.Random(5)
    top = 2**31 - 1
    starts = [(rng.choice("fg"), s, s + rng.choice([0, 1, 7, 8, 63, 64, 511, 3000])) for s in (rng.choice([1, 7, 8, 9, 64, 65, 512, 4096]) + rng.randrange(60) for _ in range(150))]
    starts += [("f", 0, top), ("f", -3, 9), ("g", 1, 0), ("g", 30, 20), ("f", top, top), ("g", -70, -2), ("f", 5, 1_000_000), ("f", 5, 1_000_000)]
    spans = [(m, f"k{i}", a, b) for i, (m, a, b) in enumerate(starts)]
    points = list(enumerate(["f", "g", "h"][i % 3] for i in range(900)))
    points = [(i, m, rng.choice([rng.randrange(-80, 700), rng.randrange(5000), top, 999_999, 0])) for i, m in points]
    for innermost, order in (("latest", lambda s: (-s[2], s[3], s[1])), ("smallest", lambda s: (s[3] - s[2], -s[2], s[1]))):
        want = {i: min((s for s in spans if s[0] == m and s[2] <= x <= s[3]), key=order, default=(None, None))[1] for i, m, x in points}
        assert placed(spark, spans, points, innermost) == want


def test_enclosing_long_spans_are_few_rows(spark):
    lines = spark.range(1, 2001).selectExpr("'f' AS module_path", "concat('s', id) AS key", "CAST(id AS INT) AS start_line", "CAST(2000000000 + id AS INT) AS end_line")
    points = spark.range(1).selectExpr("id", "'f' AS module_path", "2001 AS line")
    assert link.enclosing(points, lines, "id").collect()[0].container == "s2000"


def test_enclosing_cuts_spans_into_few_blocks(spark):
    spans = spark.range(1, 200).selectExpr("CAST(id * 1000 AS LONG) AS s", "CAST(id * 1000000 AS LONG) AS e").select("s", "e", F.explode(link._pieces(F.col("s"), F.col("e"))).alias("p"))
    width = F.pow(F.lit(2), link.LEVEL_BITS * F.col("p.level"))
    got = spans.groupBy("s", "e").agg(F.count("*").alias("n"), F.sum(width).alias("lines"), F.min(F.col("p.block") * width).alias("a"), F.max((F.col("p.block") + 1) * width - 1).alias("b")).collect()
    assert len(got) == 199 and all(r.n <= 14 * link.LEVELS and r.lines == r.e - r.s + 1 and (r.a, r.b) == (r.s, r.e) for r in got)


def test_smallest_of_long_spans(spark):
    lines = spark.range(1, 2001).selectExpr("'f' AS module_path", "concat('s', id) AS key", "CAST(id AS INT) AS start_line", "CAST(2000000000 + 2 * id AS INT) AS end_line")
    points = spark.range(1).selectExpr("id", "'f' AS module_path", "2000000100 AS line")
    assert link.enclosing(points, lines, "id", "smallest").collect()[0].container == "s50"


@pytest.mark.parametrize("innermost", ["latest", "smallest"])
def test_enclosing_sends_no_table_through_the_driver(spark, innermost):
    spans = spark.range(1, 200).selectExpr("'f' AS module_path", "concat('s', id) AS key", "CAST(id AS INT) AS start_line", "CAST(2 * id AS INT) AS end_line")
    points = spark.range(300).selectExpr("id", "'f' AS module_path", "CAST(id % 200 AS INT) AS line")
    out = link.enclosing(points, spans, "id", innermost)
    assert out.count() == 300 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
