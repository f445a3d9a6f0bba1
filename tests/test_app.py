"""Projects, tools, agents, servers and the command line, over a small wiki built from files."""

import io
import json
import time
import urllib.error
import urllib.request

import pytest

from scholia.app import agent, service
from scholia.app import project as projects
from scholia.app.chat import ChatModel, HttpChat, Scripted, extraction_models
from scholia.operators.index import WordCounts

WORDS = ["volume", "midi", "reverb"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("wiki")
    (top / "a.md").write_text("# Volume\nvolume volume Seite 2\n# Midi\nmidi clock\n")
    (top / "b.md").write_text("# Reverb\nreverb hall volume\n")
    (top / "eval").mkdir()
    (top / "eval" / "one.jsonl").write_text('{"question": "volume", "pages": "001-volume"}\n# no\n{"question": "midi", "expected": ["none"]}\n')

    class Things:
        def chat(self, messages):
            return '[{"name": "Volume", "type": "Feature"}]' if "volume" in messages[1]["content"] else "[]"

    got = service.build_wiki(spark, [str(top / "a.md"), str(top / "b.md")], str(top), WordCounts(WORDS), title="Manual", chat=Things())
    assert got["documents"]["pages"] == 3 and got["pages"] == 3 and got["graph"]["entities"] == 1 and got["graph"]["mentions"] == 2
    return top


@pytest.fixture
def wiki(spark, folder):
    return service.Wiki(spark, folder, Scripted(lambda m: "<think>hm</think>Louder [1]."), WordCounts(WORDS))


def test_build(spark, folder, wiki):
    slugs = sorted(p.stem for p in (folder / "wiki" / "pages").glob("*.md"))
    assert slugs == ["000-volume", "001-midi", "002-b"] or slugs[0].startswith("000-"), slugs
    stats = wiki.graph.stats()
    assert stats["pages"] == 3 and stats["next"] == 2 and stats["references"] >= 0 and wiki.graph.has_entities()


def test_ask_compare_and_eval(wiki, folder):
    a = wiki.ask("midi", 1, 1)
    assert a.answer == "Louder [1]." and a.cited() == {1} and a.sources[0]["marker"] == 1 and "midi" in a.sources[0]["text"] and "Sources:\n * [1]" in a.text()
    assert [s["kind"] for s in wiki.ask("midi", 1, 2).sources][0] == "seed" and len(wiki.ask("midi", 1, 0, False).sources) == 1
    both = wiki.compare("reverb", 1, 1)
    assert set(both["results"]) == {"RAG", "GraphRAG"} and both["results"]["RAG"]["answer"] == "Louder [1]."
    assert "answer" not in wiki.compare("reverb", 1, 1, answers=False)["results"]["RAG"]
    report = wiki.run_eval(wiki.eval_sets()["one"], 1, 1)
    assert report["results"]["RAG"]["n"] == 2 and "midi" in report["results"]["RAG"]["missed"] and set(report["results"]) == {"RAG", "GraphRAG"}
    wiki.judge = Scripted(["A", "A"])
    graded = wiki.answer_eval(wiki.eval_sets()["one"], 1, 1, judge=True)
    assert graded["questions"] == 2 and graded["tally"] == {"RAG": 1, "GraphRAG": 1, "tie": 0} and graded["grounding"]["RAG"]["expected_recall"] <= 0.5
    assert wiki.answer_eval(wiki.eval_sets()["one"], 1, 1, limit=1)["questions"] == 1


def test_http(wiki):
    import threading

    server = service.http_server(wiki, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        request = urllib.request.Request(at + path, json.dumps(body).encode() if body is not None else None)
        with urllib.request.urlopen(request) as r:
            return json.load(r)

    pages = call("/api/wiki")
    slug = pages[0]["slug"]
    assert len(pages) == 3 and call(f"/api/pages/{slug}")["markdown"].startswith("# ") and call("/api/project")["graph"] is True and call("/api/eval-sets") == ["one"]
    assert call("/api/health")["pages"] == 3 and call("/api/graph/stats")["pages"] == 3 and call(f"/api/graph/explore/{slug}")["root"] == slug and call(f"/api/graph/{slug}")["center"] == slug
    assert "reverb" in call("/api/search", {"query": "reverb", "k": 1})[0]["text"] and call("/api/chat", {"message": "hi"})["reply"] == "Louder [1]."
    assert call("/api/graph/expand", {"kind": "entity", "id": "Feature::volum"})["nodes"] and call("/api/compare", {"question": "midi", "answers": False})["expand_k"] == 3
    assert call("/api/eval?set=one&top_k=1")["top_k"] == 1
    assert call("/api/answer-eval", {"set": "one", "top_k": 1, "expand_k": 0})["state"] == "running"
    for _ in range(240):
        state = call("/api/answer-eval")
        if state["state"] != "running":
            break
        time.sleep(0.25)
    assert state["state"] == "done" and state["report"]["questions"] == 2
    for path in ("/api/pages/none", "/api/nothing", "/api/graph/none"):
        with pytest.raises(urllib.error.HTTPError, match="404"):
            call(path)
    server.shutdown()


def test_tools(wiki, folder):
    lib = wiki.librarian
    assert [t["name"] for t in lib.listing()] == list(agent.PURPOSES)
    (ok, listed), = lib.serve([("list_pages", {})])
    slugs = [x["slug"] for x in json.loads(listed)]
    assert ok and len(slugs) == 3 and slugs == sorted(slugs)
    got = lib.serve([
        ("search_wiki", {"query": "midi", "k": 1}), ("find_entity", {"name": "vol"}), ("graph_neighbors", {"slug": slugs[0]}), ("find_path", {"from_slug": slugs[0], "to_slug": slugs[2]}), ("find_path", {"from_slug": slugs[0], "to_slug": slugs[0]}),
        ("graph_neighbors", {"slug": "zz"}), ("find_path", {"from_slug": "zz", "to_slug": slugs[0]}), ("find_entity", {"name": "qq"}), ("none", {}), ("read_page", {}), ("read_page", {"slug": "../a"}), ("list_pages", {"sheet": 9}), ("read_page", {"slug": slugs[1]}), ("search_wiki", {"query": "volume", "k": "x"}),
    ])
    assert [ok for ok, _ in got] == [True] * 5 + [False] * 7 + [True] * 2
    hits = json.loads(got[0][1])
    assert len(hits) == 1 and "midi" in hits[0]["excerpt"] and hits[0]["slug"] in slugs and len(json.loads(got[13][1])) == 3
    assert {x["slug"] for x in json.loads(got[1][1])} <= set(slugs) and {x["name"] for x in json.loads(got[1][1])} == {"Volume"}
    assert slugs[1] in {x["slug"] for x in json.loads(got[2][1])} and json.loads(got[3][1])["nodes"][0] == slugs[0] and json.loads(got[4][1]) == {"hops": 0, "nodes": [slugs[0]], "rels": []}
    assert "no tool" in got[8][1] and got[9][1] == "read_page also takes: slug" and got[12][1].startswith("# ")


def test_edits(spark, tmp_path):
    lib = agent.Librarian(spark, tmp_path)
    (tmp_path / "pages").mkdir()
    page = tmp_path / "pages" / "a.md"
    page.write_text("# A\n\nx y x\n\n---\n\nnav\n")
    change = lambda name, **args: lib.serve([(name, args)])[0][0]
    assert change("edit_page", slug="a", old_text="y", new_text="z") and not change("edit_page", slug="a", old_text="x", new_text="q") and not change("edit_page", slug="a", old_text="no", new_text="q") and not change("edit_page", slug="b", old_text="x", new_text="q")
    assert change("append_section", slug="a", heading="New", body="body") and page.read_text() == "# A\n\nx z x\n\n\n## New\n\nbody\n\n---\n\nnav\n"
    assert change("create_page", slug="b", title="B", body="text") and (tmp_path / "pages" / "b.md").read_text() == "# B\n\ntext\n" and not change("create_page", slug="b", title="B", body="x") and not change("create_page", slug="b/c", title="t", body="b")
    assert change("create_page", slug="c", title="C", body="# Own\n\nx") and lib.serve([("read_page", {"slug": "c"})])[0][1] == "# Own\n\nx\n" and lib.log == ["changed a", "changed a", "changed b", "changed c"]
    both = lib.serve([("edit_page", {"slug": "c", "old_text": "x", "new_text": "y"}), ("append_section", {"slug": "c", "heading": "h", "body": "b"})])
    assert [ok for ok, _ in both] == [True, False] and "another call" in both[1][1]
    dry = agent.Librarian(spark, tmp_path, dry_run=True)
    assert dry.serve([("create_page", {"slug": "d", "title": "D", "body": "x"})]) == [(True, "would have changed d")] and not (tmp_path / "pages" / "d.md").exists() and dry.log == ["would have changed d"]
    assert [t["name"] for t in lib.listing()][-1] == "create_page" and not lib.serve([("search_wiki", {"query": "x"})])[0][0]


def test_edits_reach_the_graph(spark, wiki, tmp_path):
    from scholia.operators.knowledge import Graph

    wiki.graph.save(str(tmp_path / "g"))
    (tmp_path / "pages").mkdir()
    lib = agent.Librarian(spark, tmp_path, graph=Graph.load(spark, str(tmp_path / "g"), writable=True), embedder=WordCounts(WORDS))
    assert lib.serve([("create_page", {"slug": "new", "title": "New", "body": "reverb midi"})])[0][0]
    assert lib.graph.neighborhood("new")["center"] == "new" and lib.graph.neighborhood("new")["nodes"][1]["rel"] == "similar"


def test_conversation(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    lib = agent.Librarian(spark, tmp_path)
    chat = Scripted([{"tool_calls": [{"function": {"name": "create_page", "arguments": '{"slug": "p", "title": "P", "body": "x"}'}}, {"function": {"name": "read_page", "arguments": "not json"}}]}, {"content": "<think>a</think> done "}, {"content": "again"}])
    history = [*agent.opening("a manual"), {"role": "user", "content": "make p"}]
    *made, last = agent.converse(chat, lib, history)
    assert last == {"reply": "done"} and [c["tool"] for c in made] == ["create_page", "read_page"] and [c["ok"] for c in made] == [True, False] and (tmp_path / "pages" / "p.md").exists()
    history.append({"role": "user", "content": "more"})
    assert list(agent.converse(chat, lib, history)) == [{"reply": "again"}] and len(chat.asked[2]) == 7 and "a manual" in history[0]["content"]
    loop = Scripted(lambda m: {"tool_calls": [{"function": {"name": "list_pages"}}]})
    assert list(agent.converse(loop, lib, [{"role": "user", "content": "go"}], 3))[-1] == {"reply": agent.GIVEN_UP.format(3)} and isinstance(chat, ChatModel)
    request = HttpChat("m", temperature=0.5, options={"seed": 1}).request([], [{}], {"temperature": 0})
    assert request["options"] == {"temperature": 0, "seed": 1} and request["tools"] == [{}] and extraction_models("m")[1].temperature == 0.6


def test_json_rpc(wiki):
    methods = wiki.rpc()
    ask = lambda method, **params: agent.rpc_reply(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}), methods)
    assert ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "x" and ask("ping")["result"] == {} and ask("nothing")["error"]["code"] == -32601
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["wiki_ask", "wiki_search", "wiki_list_pages", "wiki_read_page", "wiki_graph_neighbors", "wiki_find_path", "wiki_find_entity"]
    assert ask("tools/call", name="wiki_ask", arguments={"question": "midi"})["result"]["content"][0]["text"].startswith("Louder [1].") and ask("tools/call", name="wiki_ask")["result"]["isError"]
    assert ask("tools/call", name="zz")["result"]["isError"] and ask("tools/call", name="create_page")["result"]["isError"] and not ask("tools/call", name="wiki_list_pages")["result"]["isError"]
    assert agent.rpc_reply('{"method": "notifications/initialized"}', methods) is None and agent.rpc_reply("[1]", methods) is None
    out = io.StringIO()
    agent.rpc_serve({"ping": lambda p: {}}, io.StringIO('\nno json\n{"id": 1, "method": "ping"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 1, "result": {}}


def test_projects(tmp_path, monkeypatch):
    p = projects.new_project(tmp_path / "one", "One", models={"embed": "hash:64"}, sources=[{"type": "md", "path": "a.md"}, {"type": "web", "path": "http://x"}])
    root = p[projects.ROOT]
    again = projects.open_project(root)
    assert projects.title_of(again) == "One" and projects.sources_of(again) == [str(root / "a.md"), "http://x"] and projects.output_of(again) == root / "output"
    projects.with_entity_types(projects.with_source(again, 'q"uo.md', "md"), ["Tool: a tool", "Part"])
    assert projects.open_project(root)["graph"]["entity_types"] == ["Tool: a tool", "Part"] and len(projects.sources_of(projects.open_project(root))) == 3
    with pytest.raises(FileExistsError):
        projects.new_project(root)
    with pytest.raises(FileNotFoundError):
        projects.open_project(tmp_path)
    (tmp_path / "one" / "deep").mkdir()
    monkeypatch.delenv(projects.VARIABLE, raising=False)
    monkeypatch.chdir(tmp_path / "one" / "deep")
    name = lambda *a, **kw: projects.title_of(projects.current_project(*a, **kw))
    assert name() == "One"
    two = projects.new_project(tmp_path / "two")
    monkeypatch.setenv(projects.VARIABLE, str(two[projects.ROOT]))
    assert name() == "two" and name(root) == "One"
    monkeypatch.delenv(projects.VARIABLE)
    monkeypatch.chdir(tmp_path)
    registry = projects.Registry(tmp_path / "home" / "projects.toml")
    assert projects.current_project(registry=registry) is None
    registry.add("my two", two[projects.ROOT]).use("my two")
    again = projects.Registry(registry.path)
    assert again.active == "my two" and name(registry=again) == "two" and name("my two", registry=again) == "two"
    with pytest.raises(KeyError):
        again.use("none")
    assert again.remove("my two").active is None
    (tmp_path / "bad.toml").write_text("= broken")
    assert projects.Registry(tmp_path / "bad.toml").projects == {} and projects.UserConfig(tmp_path / "bad.toml").get("models", "embed") is None
    (tmp_path / "user.toml").write_text('[models]\nembed = "user"\nchat = "c"\n')
    user = projects.UserConfig(tmp_path / "user.toml")
    of = lambda key, flag=None: projects.setting("models", key, "default", flag, p, user)
    assert (of("embed", "flag"), of("embed"), of("chat"), of("none")) == ("flag", "hash:64", "c", "default")
    state = projects.state_of(p).record("wiki", "f1", str(tmp_path), pages=3)
    assert projects.BuildState(state.path).built == {"wiki": "f1"} and projects.signature([str(tmp_path / "none"), "http://x"]) == [None, "http://x"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv(projects.VARIABLE, raising=False)
    monkeypatch.chdir(tmp_path)
    run = lambda *args, chat=None: (service.main(list(args), spark, chat, tmp_path / "home"), capsys.readouterr().out)
    assert run("status")[0] == 2
    assert run("init", "kb")[0] == 0 and "kb" in run("project", "list")[1]
    (tmp_path / "kb" / "a.md").write_text("# One\nvolume\n# Two\nmidi\n")
    on = ("--project", str(tmp_path / "kb"))
    assert run(*on, "project", "add-source", "a.md")[0] == 0 and "wiki: missing" in run(*on, "status")[1]
    built = json.loads(run(*on, "build")[1])
    assert built["pages"] == 2 and built["graph"]["pages"] == 2 and "graph: up to date" in run(*on, "status")[1] and run(*on, "build")[1] == ""
    assert "000-one" in run(*on, "search", "volume", "-k", "1")[1]
    said = Scripted(lambda m: '[{"name": "Sound", "description": "loud"}]' if "Name 2" in m[0]["content"] else "Yes [1]")
    assert run(*on, "ask", "volume", chat=said)[1].startswith("Yes [1]\n\nSources:\n *") and run(*on, "chat", "hi", chat=said)[1] == "Yes [1]\n" and run(*on, "ontology", "-n", "2", chat=said)[1] == "Sound: loud\n"
    (tmp_path / "set.jsonl").write_text('{"question": "volume", "pages": ["000-one"]}\n')
    assert json.loads(run(*on, "eval", str(tmp_path / "set.jsonl"))[1])["results"]["RAG"]["mrr"] == 1
