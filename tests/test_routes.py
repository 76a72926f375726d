"""Closures of the route operators beyond any fixed depth."""

from faultline.operators import routes


def test_long_include_chain(spark):
    chain = [("query", "s0"), *((f"s{i}", f"s{i + 1}") for i in range(11)), ("s11", "s3")]
    out = routes.included_scopes(spark.createDataFrame(chain, "scope string, included string"))
    assert {r["at"] for r in out.filter("origin = 'query'").collect()} == {"query", *(f"s{i}" for i in range(12))}


def test_long_selection_path(spark):
    path = ["edges", "node"] * 6
    sel = spark.createDataFrame([(1, "Edge", path), (2, "Edge", [*path, "nope"]), (3, "Edge", ["edges"])], "selection int, root_type string, path array<string>")
    fields = spark.createDataFrame([("Edge", "edges", "Node", "Edge.edges"), ("Node", "node", "Edge", "Node.node")], "type string, field string, returns string, field_key string")
    assert {tuple(r) for r in routes.descend(sel, fields).collect()} == {(1, "Node.node"), (3, "Edge.edges")}
