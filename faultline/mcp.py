"""Tools over standard input and output: one JSON-RPC message per line."""

from __future__ import annotations

import json
from typing import TextIO

from . import api

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}


def _schema(required: dict, **optional) -> dict:
    return {"type": "object", "properties": required | optional, "required": list(required)}


TOOLS = {
    "locate": ("Entry points of a task described in words", _schema({"task": _TEXT}, limit=_NUMBER)),
    "search": ("Symbols by name", _schema({"query": _TEXT}, limit=_NUMBER)),
    "impact": ("What a change of a symbol is likely to break", _schema({"symbol": _TEXT}, limit=_NUMBER, in_file=_TEXT)),
    "review_focus": ("What to read first in a change", _schema({"changed": {"type": "array", "items": {"type": "object"}}}, limit=_NUMBER)),
    "neighbors": ("Edges around a symbol", _schema({"symbol": _TEXT}, direction=_TEXT, depth=_NUMBER, limit=_NUMBER)),
    "risk": ("Risk of a symbol", _schema({"symbol": _TEXT})),
    "path": ("Routes between two symbols", _schema({"start": _TEXT, "goal": _TEXT}, depth=_NUMBER, limit=_NUMBER)),
    "explain_edge": ("Edges between two symbols", _schema({"a": _TEXT, "b": _TEXT})),
    "reindex": ("Index trees again", _schema({"roots": {"type": "array", "items": _TEXT}})),
}


def call(state: dict, name: str, args: dict) -> list[dict]:
    engine: api.Engine = state["engine"]
    if name == "reindex":
        state["engine"] = engine = api.Engine.index_roots(engine.spark, args["roots"])
        return [{"nodes": engine.nodes.count(), "edges": engine.edges.count()}]
    limit = {"limit": args["limit"]} if "limit" in args else {}
    budget = {"budget": args["limit"]} if "limit" in args else {}
    if name == "locate":
        out = engine.locate(args["task"], **budget)
    elif name == "search":
        out = engine.search(args["query"], **limit)
    elif name == "impact":
        out = engine.impact(args["symbol"], in_file=args.get("in_file"), **budget)
    elif name == "review_focus":
        rows = [(c["module_path"], int(c["from_line"]), int(c["to_line"])) for c in args["changed"]]
        out = engine.review(engine.spark.createDataFrame(rows, "module_path string, from_line int, to_line int"), **budget)
    elif name == "neighbors":
        out = engine.neighbors(args["symbol"], args.get("direction", "out"), None, args.get("depth", api.NEIGHBORS_DEPTH), **limit)
    elif name == "risk":
        out = engine.risk(args["symbol"])
    elif name == "path":
        out = engine.path(args["start"], args["goal"], args.get("depth", api.PATH_DEPTH), **limit)
    elif name == "explain_edge":
        out = engine.explain_edge(args["a"], args["b"])
    else:
        raise KeyError(name)
    return [json.loads(x) for x in out.toJSON().collect()]


def handle(state: dict, message: dict) -> dict | None:
    method, ident = message.get("method"), message.get("id")
    if ident is None:
        return None
    reply = {"jsonrpc": "2.0", "id": ident}
    try:
        if method == "initialize":
            return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "faultline", "version": "0.1.0"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}}
        if method == "tools/call":
            rows = call(state, message["params"]["name"], message["params"].get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(rows)}]}}
    except KeyError as e:
        return reply | {"error": {"code": -32602, "message": f"unknown or missing: {e}"}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: api.Engine, source: TextIO, sink: TextIO) -> None:
    state = {"engine": engine}
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(state, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
