"""Trees to snapshots, increments, the API, the pack and watch mode."""

import json
import time

import pytest
from pyspark.sql import functions as F

from srcatlas import cli
from srcatlas.api import Atlas, AtlasError
from srcatlas.functions.embed import HashingEmbedder
from srcatlas.plans import pack
from srcatlas.sources import scan
from srcatlas.sources.snapshot import Store, derive_repo_name, refresh, slug
from srcatlas.streaming.watch import watch

APP = '''"""App."""
class CheckoutRequest:
    pass

def charge_card(request):
    return request

@app.get("/checkout")
def create_checkout():
    return charge_card(CheckoutRequest())
'''


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    for name, text in {"app.py": APP, "docs/checkout.md": "# Checkout\nHow checkout works.\n", "tests/test_checkout.py": "def test_checkout():\n    create_checkout()\n", "ignored/secret.py": "def secret(): pass\n", ".gitignore": "ignored/\n", "pkg/__init__.py": "VALUE = 1\n", "node_modules/x.js": "function x() {}", "a.png": "x"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root


def test_ignore_rules(spark):
    lines = [*scan.DEFAULT_IGNORES, "# c", "", "secrets.txt", "/top.py", "a/*.log", "**/deep/x", "keep/*", "!keep/this.py", "sp\\ ace", "[ab].py"]
    paths = {"src/main.py": False, "__pycache__/x": True, "q/__pycache__/y.py": True, "d/secrets.txt": True, "top.py": True, "s/top.py": False, "a/z.log": True, "a/b/z.log": False, "p/q/deep/x": True, "deep/x/y": True, "keep/that.py": True, "keep/this.py": False, "x.min.js": True, "sp ace": True, "q/a.py": True, "c.py": False}
    df = spark.createDataFrame(list(paths.items()), "p string, want boolean").withColumn("got", scan.ignored(F.col("p"), lines))
    assert [(r["p"], r["got"]) for r in df.collect() if r["want"] != r["got"]] == []


def test_names():
    assert slug(" My Repo! ") == "my-repo" and slug("!!") == "repo"
    assert derive_repo_name("/x/My App", branch="feat/a b").startswith("my-app-feat-a-b-")
    assert derive_repo_name("/x", "N A") == "n-a"


def test_increments(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    first = refresh(store, str(tree), "Shop")
    assert (first["repo"], first["indexed"], first["skipped"]) == ("shop", 5, 0)
    paths = {r["path"] for r in store.table("files").collect()}
    assert paths == {"app.py", "docs/checkout.md", "tests/test_checkout.py", ".gitignore", "pkg/__init__.py"}
    assert refresh(store, str(tree), "shop") == {"repo": "shop", "indexed": 0, "skipped": 5, "removed": 0}
    (tree / "new.py").write_text("def fresh():\n    create_checkout()\n")
    (tree / "app.py").write_text(APP + "\ndef more():\n    pass\n")
    (tree / "docs/checkout.md").unlink()
    assert refresh(store, str(tree), "shop")["indexed"] == 2
    names = {r["name"] for r in store.table("symbols").collect()}
    assert {"fresh", "more", "charge_card", "Checkout", "test_checkout"} <= names
    assert store.table("edges").where("callee_name = 'create_checkout' AND callee_file = 'app.py'").count() == 2
    assert store.table("edges").where("caller_name = 'create_checkout' AND callee_name = 'charge_card'").count() == 1
    assert refresh(store, str(tree), "shop", prune_missing=True)["removed"] == 1
    assert store.table("symbols").where("name = 'Checkout'").count() == 0
    assert refresh(store, str(tree), "shop", embedder=HashingEmbedder(8))["indexed"] == 0  # unchanged, but embedded
    assert store.table("symbols").where("embedding IS NULL").count() == 0
    assert json.loads((tmp_path / "index/repos.json").read_text())[0]["name"] == "shop"
    assert store.gc() > 0 and store.table("files").count() == 5


def test_api(spark, tree, tmp_path, capsys):
    atlas = Atlas(spark, str(tmp_path / "index"), HashingEmbedder(16))
    for call, key in ((lambda: atlas.index_folder(str(tmp_path / "none")), "invalid_request"), (lambda: atlas.search_routes("shop"), "repo_not_indexed"), (lambda: atlas.search_symbols(" "), "invalid_request")):
        with pytest.raises(AtlasError) as e:
            call()
        assert e.value.key == key
    atlas.index_folder(str(tree), "shop", embed=True)
    hit = atlas.search_symbols("charge", "SHOP").first()
    assert hit["name"] == "charge_card" and hit["quality"]["confidence"] == 0.92 and hit["quality"]["has_embeddings"]
    got = atlas.get_symbol("shop", "app.py", hit["start_byte"], hit["end_byte"]).first()
    assert got["source"].startswith("def charge_card") and got["source"].endswith("return request")
    assert [r["name"] for r in atlas.get_callers("charge_card", "shop").collect()] == ["create_checkout"]
    assert {r["callee_name"] for r in atlas.get_callees("create_checkout", "shop").collect()} == {"charge_card", "CheckoutRequest"}
    with pytest.raises(AtlasError) as e:
        atlas.get_callers("nobody", "shop")
    assert e.value.as_dict()["error"]["code"] == 404
    assert [(r["method"], r["path"], r["handler"]) for r in atlas.search_routes("shop", path_contains="check").collect()] == [("GET", "/checkout", "create_checkout")]
    assert {r["file"] for r in atlas.search_text("checkout", "shop", "*.md").collect()} == {"docs/checkout.md"}
    assert 0 <= atlas.semantic_search("charge card", "shop", 1).first()["score"] <= 1
    status = atlas.get_index_status("shop").first()
    assert status["file_count"] == 5 and status["age_seconds"] >= 0
    stats = atlas.get_repo_stats("shop")
    assert stats["languages"]["python"] == 3 and stats["edge_count"] == 3 and stats["route_count"] == 1
    assert "app.py" in atlas.get_file_tree("shop") and atlas.get_graph_diagram("shop", "app.py")["node_count"] == 2
    assert atlas.find_circular_deps("shop").collect()[0]["cycle"] == ["app.py", "app.py"]
    assert [r["name"] for r in atlas.get_file_outline("shop", "app.py").collect()] == ["CheckoutRequest", "charge_card", "create_checkout"]
    assert cli.main([str(tmp_path / "index"), "callers", "charge_card", "shop"], spark) == 0
    assert "create_checkout" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "index"), "routes", "nope"], spark) == 1
    assert cli.main([str(tmp_path / "index"), "list-repos"], spark) == cli.main([str(tmp_path / "index"), "status", "shop"], spark) == cli.main([str(tmp_path / "index"), "tree", "shop", "--depth", "1"], spark) == 0
    assert "watcher_active" in capsys.readouterr().out
    outline = atlas.get_repo_outline("shop")
    assert "app.py" in outline["tree"] and outline["stats"]["files"] == 5 and outline["stats"]["symbols"] > 3
    for call in (lambda: atlas.get_file_outline("shop", "none.py"), lambda: atlas.get_symbol("shop", "none.py", 0, 5)):
        with pytest.raises(AtlasError) as e:
            call()
        assert e.value.key == "file_not_found"
    assert atlas.get_symbol("shop", "app.py", 0, 10).first()["source"] == '"""App."""' and atlas.find("charge_card", "shop").first()["file"] == "app.py"
    assert atlas.invalidate_cache("shop", "app.py") == 1
    assert atlas.search_routes("shop").count() == 0 and atlas.search_symbols("charge", "shop").count() == 0
    for p in sorted(tree.rglob("*"), reverse=True):
        p.unlink() if p.is_file() else p.rmdir()
    tree.rmdir()
    assert atlas.gc_stale_indexes() == ["shop"] and atlas.list_repos().count() == 0


def test_pack(spark, tree, tmp_path):
    atlas = Atlas(spark, str(tmp_path / "index"))
    atlas.index_folder(str(tree), "shop")
    rows = atlas.build_context_pack("shop", "checkout", token_budget=30).orderBy("n").collect()
    assert {r["state"] for r in rows} >= {"selected", "omitted"} and sum(r["used_tokens"] for r in rows) <= 27
    assert rows == atlas.build_context_pack("shop", "checkout", token_budget=30).orderBy("n").collect()
    assert not any("secret" in (r["source"] or "") for r in rows)
    # the fold against a plain loop
    used, first = 0, True
    for r in rows:
        if r["estimated_tokens"] <= 27 - used:
            assert r["state"] == "selected"
            used, first = used + r["estimated_tokens"], False
        elif first:
            assert r["state"] == "outlined" and r["source"].endswith(r["file"])
            used, first = used + r["used_tokens"], False
        else:
            assert r["state"] == "omitted"
    only = atlas.build_context_pack("shop", "checkout", include=["routes"]).collect()
    assert {r["type"] for r in only} == {"route"} and only[0]["bucket"] == "routes"
    assert "test" not in {r["type"] for r in atlas.build_context_pack("shop", "checkout", exclude=["tests"]).collect()}
    assert {r["type"] for r in rows} >= {"symbol", "route", "doc", "test", "graph_neighbor"}
    assert pack.limits(0) == (6000, 600, 5400) and pack.limits(-4) == (1, 1, 1)
    with pytest.raises(AtlasError):
        atlas.build_context_pack("shop", "  ")
    head = atlas.context_pack_header("shop", "checkout", 30, include="routes, typo")
    assert head["warnings"] == ["unknown include filter ignored: typo"] and head["budget"]["available_tokens"] == 27 and head["quality_summary"]["item_count"] >= 1
    head = atlas.context_pack_header("shop", "checkout", 30)
    assert head["warnings"] == ["semantic search skipped: repo has no embeddings"] and head["quality_summary"]["index_fresh"] and "omitted" in head["agent_hint"]
    plan = atlas.build_context_pack("shop", "checkout", include=["symbols"])
    assert {r["type"] for r in plan.collect()} == {"symbol"}


def test_watch(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    refresh(store, str(tree), "shop")
    query = watch(store, str(tree), "shop", str(tmp_path / "ck"), interval="1 second", idle_seconds=8)
    try:
        (tree / "late.py").write_text("def late(): pass\n")
        (tree / "app.py").unlink()
        for _ in range(60):
            names = {r["name"] for r in store.table("symbols").collect()}
            if "late" in names and "charge_card" not in names:
                break
            time.sleep(1)
        assert "late" in names and "charge_card" not in names
        assert query.awaitTermination(90)  # idle
    finally:
        query.stop()


def test_a_commit_touches_one_repository(spark, tree, tmp_path):
    """The other one's files stay as they are, and a reader never meets an empty index."""
    import os
    import threading

    store = Store(spark, str(tmp_path / "index"))
    refresh(store, str(tree), "one")
    refresh(store, str(tree / "docs"), "two")
    stamp = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "index/data/two") for f in fs}
    before, seen, done = stamp(), [], threading.Event()

    def look():
        while not done.is_set():
            seen.append(set(store.manifest()))

    reader = threading.Thread(target=look)
    reader.start()
    (tree / "more.py").write_text("def more(): pass\n")
    assert refresh(store, str(tree), "one", quick=True) == {"repo": "one", "indexed": 1, "skipped": 5, "removed": 0}
    done.set()
    reader.join()
    assert stamp() == before and all(s == {"one", "two"} for s in seen) and len(seen) > 3
    assert {r["repo"] for r in store.table("files").collect()} == {"one", "two"} and {r["repo"] for r in store.table("files", "two").collect()} == {"two"}
    store.views("at_")
    assert spark.sql("SELECT count(DISTINCT repo) AS n FROM at_files").first()["n"] == 2
    assert store.gc() == 1 and store.table("symbols", "one").where("name = 'more'").count() == 1


def test_one_watcher(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    store.claim("r", 60)
    assert store.watched("r")
    with pytest.raises(RuntimeError):
        store.claim("r", 60)
    time.sleep(0.05)
    store.claim("r", 0.01)
    store.release("r")
    assert not store.watched("r")


def test_branches_and_registry_paths(tmp_path):
    from srcatlas.sources.snapshot import from_registry, git_branch, to_registry

    assert git_branch(str(tmp_path)) is None
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/feat/A b\n")
    assert git_branch(str(tmp_path)) == "feat-a-b"
    (tmp_path / ".git/HEAD").write_text("0" * 40)
    assert git_branch(str(tmp_path)) is None
    assert Store(None, "x", str(tmp_path)).workspace == str(tmp_path)
    work = str(tmp_path)
    for path, want in ((f"{work}/a/b", "./a/b"), (work, "."), (str(tmp_path.parent), "..")):
        assert to_registry(path, work) == want and from_registry(want, work) == path
    assert to_registry("/x/y") == "/x/y" == from_registry("/x/y", work)


def test_listing_reads_nothing_it_skips(spark, tree):
    """Skipped folders aren't read, names with marks are taken as they are."""
    (tree / "we[i]rd {x}.py").write_text("def weird(): pass\n")
    got = {r["path"]: bytes(r["content"]) for r in scan.scan_tree(spark, str(tree), "r").collect()}
    assert got["we[i]rd {x}.py"].startswith(b"def weird") and got["pkg/__init__.py"] == b"VALUE = 1\n" and "node_modules/x.js" not in got
    scan_plan = scan.list_tree(spark, str(tree), "r")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan_plan
