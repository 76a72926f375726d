"""Own small trees through discovery, extraction, linking and the answers."""

import json
import subprocess

import pytest

from faultline import api, mcp
from faultline.sources import git

TREE = {
    "app/util.py": 'def load(path):\n    """Reads a file."""\n    return open(path).read()\n\n\ndef unused():\n    pass\n',
    "app/store.py": "from .util import load\nimport requests\n\n\nclass Store:\n    def save(self, x):\n        self.check(x)\n        return load(x)\n\n    def check(self, x):\n        return requests.get(x)\n",
    "app/main.py": "from app.store import Store\nfrom app import util\n\n\ndef main():\n    s = Store()\n    s.save('a')\n    util.load('b')\n",
    "tests/test_store.py": "from app.store import Store\n\n\ndef test_save():\n    s = Store()\n    s.save('x')\n",
    "web/client.ts": "import { render } from './view';\n\nexport async function fetchUser(id: string) {\n  const r = await fetch(`/users/${id}`);\n  render(r);\n}\n",
    "web/view.ts": "export function render(x: any) {\n  return x;\n}\n",
    "api/server.js": "function showUser(req, res) {\n  res.send(1);\n}\napp.get('/users/:id', showUser);\n",
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@view/*": ["web/*"],},}}',
    "web/page.ts": "import { render } from '@view/view';\nimport * as v from './view';\n\nexport function page() {\n  render(1);\n  v.render(2);\n}\n",
    "spec/openapi.json": '{\n"openapi": "3.0.0",\n"paths": {"/users/{id}": {"get": {}}}}',
    "gql/schema.graphql": "type Query {\n  user(id: ID!): User\n  users: [User!]\n}\n\ntype User {\n  id: ID\n  team: Team\n}\n\ntype Team { title: String }\n",
    "gql/ops.graphql": "query GetUser($id: ID!) {\n  user(id: $id) { id team { title } }\n  ...More\n}\nfragment More on Query { users { id } }\n",
    "lib/schema.ex": "defmodule App.Schema do\n  object :accounts do\n    field :user, :user do\n      arg(:id, :id)\n      resolve(&App.Accounts.find_user/2)\n    end\n  end\n\n  query do\n    import_fields(:accounts)\n  end\nend\n",
    "lib/accounts.ex": "defmodule App.Accounts do\n  alias App.User\n  import App.Helpers\n\n  def find_user(id) do\n    clean(id)\n    App.Helpers.Deep.audit(id)\n    Repo.get(User, id)\n  end\nend\n",
    "lib/helpers.ex": "defmodule App.Helpers do\n  def clean(x) do\n    x\n  end\nend\n",
    "lib/deep.ex": "defmodule App.Helpers.Deep do\n  def audit(x) do\n    x\n  end\nend\n",
    "lib/user.ex": "defmodule App.User do\n  schema \"users\" do\n    x\n  end\nend\n",
    "node_modules/x/index.js": "function hidden() {}\n",
    "notes.txt": "nothing",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree):
    return api.Engine.index_roots(spark, [str(tree)], store=str(tree / ".faultline" / "index"))


def edges(engine):
    return {(r.src, r.dst, r.kind): r.confidence for r in engine.edges.collect()}


def test_links(engine):
    e = edges(engine)
    assert e[("app/store.py#Store.save", "app/util.py#load", "Calls")] == pytest.approx(0.95)
    assert e[("app/store.py#Store.save", "app/store.py#Store.check", "Calls")] == pytest.approx(0.9)
    assert e[("app/main.py#main", "app/store.py#Store.save", "Calls")] == pytest.approx(0.85)
    assert e[("app/main.py#main", "app/util.py#load", "Calls")] == pytest.approx(0.9)
    assert e[("app/store.py#Store.check", "requests.get", "Calls")] == pytest.approx(0.9)
    assert e[("app/store.py#<module>", "requests", "Imports")] == pytest.approx(0.95)
    assert e[("web/client.ts#fetchUser", "web/view.ts#render", "Calls")] == pytest.approx(0.95)
    assert e[("tests/test_store.py#test_save", "app/store.py#Store.save", "Tests")] == pytest.approx(0.68)
    assert any(k == "HttpCall" and s == "web/client.ts#fetchUser" for s, _, k in e)


def test_path_alias_stays_local(engine):
    e = edges(engine)
    assert e[("web/page.ts#page", "web/view.ts#render", "Calls")] >= 0.9
    assert ("web/page.ts#<module>", "web/view.ts#<module>", "Imports") in e and not any(d.startswith("@view") for _, d, _ in e)


def test_specification_provides_routes(engine):
    assert edges(engine)[("web/client.ts#fetchUser", "spec/openapi.json#<module>", "HttpCall")] > 0


def test_graphql_links(engine):
    e = edges(engine)
    op = "gql/ops.graphql#GetUser"
    # One candidate in the schema and one resolver share the base.
    assert e[(op, "gql/schema.graphql#Query.user", "GraphqlCall")] == pytest.approx(0.9 / 3)
    assert e[(op, "lib/accounts.ex#App.Accounts.find_user", "GraphqlCall")] == pytest.approx(0.9 / 3)
    assert (op, "gql/schema.graphql#Query.users", "GraphqlCall") in e  # by a fragment
    assert e[(op, "gql/schema.graphql#Team.title", "GraphqlCall")] == pytest.approx(0.9)  # by descent
    assert e[("lib/accounts.ex#App.Accounts.find_user", "gql/schema.graphql#Query.user", "Serves")] == pytest.approx(0.9)


def test_named_modules(engine):
    e = edges(engine)
    me = "lib/accounts.ex#App.Accounts.find_user"
    assert e[(me, "lib/helpers.ex#App.Helpers.clean", "Calls")] == pytest.approx(0.9)
    assert (me, "lib/deep.ex#App.Helpers.Deep.audit", "Calls") in e
    assert e[(me, "lib/user.ex#App.User", "DbQuery")] == pytest.approx(0.85)


def test_locate_reaches_a_handler_through_its_route(engine):
    assert {r.key: r.route_path for r in engine.nodes.filter("route_path IS NOT NULL").collect()}["api/server.js#showUser"] == "users"
    assert "api/server.js#showUser" in [r.key for r in engine.locate("users endpoint").collect()]


def test_ignored_folders_and_unknown_files(engine):
    paths = {r.module_path for r in engine.nodes.select("module_path").collect()}
    assert not any("node_modules" in p or p == "notes.txt" for p in paths)


def test_answers(engine):
    hits = [r.key for r in engine.impact("load").collect()]
    assert "app/store.py#Store.save" in hits and "app/main.py#main" in hits
    assert engine.is_reachable("main", "load") and not engine.is_reachable("load", "main")
    assert engine.imports("requests") and not engine.imports("numpy")
    assert [r.key for r in engine.uses("requests", "get").collect()] == ["app/store.py#Store.check"]
    assert engine.search("save").first().key == "app/store.py#Store.save"
    assert engine.locate("load the file").first().key == "app/util.py#load"


def test_review(spark, engine):
    changed = spark.createDataFrame([("app/util.py", 2, 3)], "module_path string, from_line int, to_line int")
    top = engine.review(changed).first()
    assert top.key == "app/util.py#load" and top.changed_lines == 2 and "downstream" in top.reasons


def test_incremental_equals_full(spark, tree, engine):
    path = tree / "app" / "util.py"
    before = path.read_text()
    path.write_text(before + "\n\ndef fresh():\n    return load('z')\n")
    try:
        store = str(tree / ".faultline" / "index")
        again = api.Engine.index_roots(spark, [str(tree)], store=store)
        full = api.Engine.index_roots(spark, [str(tree)])
        assert edges(again) == edges(full)
        assert ("app/util.py#fresh", "app/util.py#load", "Calls") in edges(again)
        assert edges(api.Engine.load(spark, store)) == edges(full)
    finally:
        path.write_text(before)


def test_adding_a_root_keeps_edges(spark, tree, engine, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "b.py").write_text("def load(x):\n    return x\n")
    name = tree.name
    both = edges(api.Engine.index_roots(spark, [str(tree), str(other)]))
    own = {(f"{name}/{s}", f"{name}/{d}", k) for s, d, k in edges(engine) if "." in s and not d.startswith("requests")}
    assert own <= set(both)


def test_tools(engine):
    state = {"engine": engine}
    ask = lambda name, **a: json.loads(mcp.handle(state, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]["content"][0]["text"])
    assert len(mcp.handle(state, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 9
    assert ask("search", query="load")[0]["name"] == "load"
    assert ask("path", start="main", goal="load")[0]["hops"] == 1
    assert "error" in mcp.handle(state, {"id": 2, "method": "tools/call", "params": {"name": "nope"}})


def test_history(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)

    def commit(message, **files):
        for f, text in files.items():
            (tmp_path / f"{f}.py").write_text(text)
        run("add", "-A")
        run("commit", "-qm", message)

    run("init", "-q")
    commit("start", a="1\n", b="1\n")
    commit("work", a="1\n2\n", b="1\n2\n")
    commit("fix crash", a="1\n3\n", b="1\n3\n")
    run("mv", "a.py", "c.py")
    run("commit", "-qm", "move")
    (tmp_path / "b.py").write_text("1\n3\n4\n")
    log = git.history(spark, str(tmp_path))
    files = api.commit_files(log)
    stats = {r.file: (r.commits, r.fixes) for r in __import__("faultline.operators.overlay", fromlist=["x"]).file_stats(files).collect()}
    assert stats["c.py"] == (3, 1) and stats["b.py"] == (2, 1) and "a.py" not in stats
    assert [tuple(r) for r in git.changed_ranges(spark, str(tmp_path)).collect()] == [("b.py", 3, 3)]
    fix = log.filter("message = 'fix crash'").first().sha
    origin = log.filter("message = 'work'").first().sha
    assert {tuple(r) for r in git.blamed(spark, str(tmp_path), [fix]).collect()} == {(fix, "a.py", origin, 1), (fix, "b.py", origin, 1)}
