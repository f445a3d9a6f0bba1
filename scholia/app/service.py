"""A wiki as a service: search, answers with sources, comparison of retrievers, evaluation, graph; over HTTP and from the command line."""

from __future__ import annotations

import argparse
import json
import re
import sys
import threading
from dataclasses import dataclass, field
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.ontology import lines_of
from ..functions.tables import written
from ..functions.text import snippet
from ..operators import entities, evaluate, graph, render, restructure, retrieve, sample
from ..operators import references as cross
from ..operators.index import Index, embedder_of
from ..operators.knowledge import Graph, wiki_pages
from ..sinks import wiki as wiki_files
from ..sources import documents, readers
from . import agent
from . import project as projects


@dataclass
class Answer:
    question: str
    answer: str
    sources: list[dict] = field(default_factory=list)

    def cited(self) -> set[int]:
        return {int(x) for x in re.findall(r"\[(\d+)\]", self.answer)}

    def text(self) -> str:
        """The answer with its sources: * cited, + found over the graph."""
        rows = [f" {'*' if s['marker'] in self.cited() else ' '}{'+' if s['kind'] == 'related' else ' '}[{s['marker']}] {s['title']}  ·  pages/{s['page']}.md" for s in self.sources]
        return "\n".join([self.answer, "", *(["Sources:", *rows] if rows else [])]).strip()


class Wiki:
    """One wiki's folder (pages, index, graph) and the models that speak for it."""

    def __init__(self, spark: SparkSession, folder, chat=None, embedder=None, judge=None):
        self.spark, self.folder, self.chat, self.judge = spark, Path(folder), chat, judge
        there = lambda name: (self.folder / name).exists()
        self.index = Index.load(spark, str(self.folder / "index"), embedder) if there("index/chunks") else None
        self.graph = Graph.load(spark, str(self.folder / "graph")) if there("graph/edges") else None
        self.librarian = agent.Librarian(spark, self.folder / "wiki", self.index, self.graph, self.index.embedder if self.index else None)
        self.history = agent.opening()
        self.lock, self.job = threading.Lock(), {"state": "idle"}

    def retrieve(self, question: str, top_k: int | None = None, expand_k: int | None = None, with_graph: bool = True) -> list[dict]:
        """Sources of a question: seeds, then related pages, with running markers."""
        if self.index is None:
            raise RuntimeError("there is no index")
        top_k, expand_k = retrieve.clamped(top_k, expand_k)
        q = written(self.index.questions(self.spark.createDataFrame([(0, question)], "qid int, question string")), "question")
        found = retrieve.seeds(q, self.index.chunks, top_k).select("qid", "id", "page", "score", "marker", F.lit("seed").alias("kind"))
        if with_graph and self.graph is not None and expand_k:
            found = written(found, "seeds")
            near = graph.neighborhood(self._around(found), self.graph.mentions)
            found = found.unionByName(retrieve.expand(q, found, self.index.chunks, near, expand_k).withColumn("kind", F.lit("related")))
        return [r.asDict() for r in self.index.retrieved(found).orderBy("marker").collect()]

    def _around(self, found):
        """The edges at the found pages."""
        some = found.select(F.col("page").alias("src")).distinct()
        e = self.graph.edges.filter(F.col("rel").isin(*graph.PATH_RELATIONS))
        return e.join(some, "src", "left_semi").unionByName(e.join(some.withColumnRenamed("src", "dst"), "dst", "left_semi")).distinct()

    def ask(self, question: str, top_k: int | None = None, expand_k: int | None = None, with_graph: bool = True) -> Answer:
        sources = self.retrieve(question, top_k, expand_k, with_graph)
        if not sources:
            return Answer(question, retrieve.NOTHING)
        rows = self.spark.createDataFrame([(0, s["marker"], s["kind"], s["title"], s["page_start"], s["page_end"], s["text"]) for s in sources], "qid int, marker int, kind string, title string, page_start int, page_end int, text string")
        prompt = retrieve.prompts(self.spark.createDataFrame([(0, question)], "qid int, question string"), rows).first()["prompt"]
        said = self.chat.chat([{"role": "system", "content": retrieve.RULES}, {"role": "user", "content": prompt}])
        return Answer(question, re.sub(r"(?s)<think>.*?</think>", "", said).strip(), sources)

    def compare(self, question: str, top_k: int | None = None, expand_k: int | None = None, answers: bool = True) -> dict:
        """Both retrievers, with the same budget, on one question."""
        top_k, expand_k = retrieve.clamped(top_k, expand_k)
        out = {}
        for name, seeds, more, with_graph in (("RAG", top_k + expand_k, 0, False), ("GraphRAG", top_k, expand_k, True)):
            if answers and self.chat is not None:
                a = self.ask(question, seeds, more, with_graph)
                out[name] = {"answer": a.answer, "cited": sorted(a.cited()), "sources": a.sources}
            else:
                out[name] = {"sources": self.retrieve(question, seeds, more, with_graph)}
        return {"question": question, "top_k": top_k, "expand_k": expand_k, "results": out}

    def eval_items(self, path: str):
        items = written(readers.eval_set(self.spark.read.text(path)).withColumn("qid", F.monotonically_increasing_id()), "questions")
        return written(self.index.questions(items), "items")

    def run_eval(self, path: str, top_k: int | None = None, expand_k: int | None = None) -> dict:
        """MRR, hit rate, recall and misses of both retrievers over a set of questions."""
        top_k, expand_k = retrieve.clamped(top_k, expand_k)
        items = self.eval_items(path)
        near = graph.neighborhood(self.graph.edges, self.graph.mentions) if self.graph else None
        out = {"top_k": top_k, "expand_k": expand_k, "results": {}}
        for name, f in zip(("RAG", "GraphRAG"), retrieve.retrievers(self.index.chunks, near, top_k, expand_k), strict=True):
            if f is not None:
                scored, report = evaluate.evaluate(items, f, top_k + expand_k)
                scored = written(scored, "scored")
                out["results"][name] = evaluate.report(scored, top_k + expand_k).first().asDict() | {"missed": [r["question"] for r in scored.filter("hit = 0").select("question").collect()]}
        return out

    def answer_eval(self, path: str, top_k: int | None = None, expand_k: int | None = None, judge: bool = False, limit: int | None = None) -> dict:
        """Answers of both systems: how often they cite an expected page, how many of these, and (judge) which answer a judge prefers."""
        top_k, expand_k = retrieve.clamped(top_k, expand_k, 10)
        items = [r for r in readers.eval_set(self.spark.read.text(path)).collect()][:limit]
        n, graded, shown = len(items), [], []
        for k, item in enumerate(items):
            both = {"RAG": self.ask(item["question"], top_k, 0, False), "GraphRAG": self.ask(item["question"], top_k, expand_k)}
            for name, a in both.items():
                cited, expected = {s["page"] for s in a.sources if s["marker"] in a.cited()}, set(item["expected"])
                graded.append((name, bool(cited & expected), len(cited & expected) / len(expected) if expected else 0.0))
            shown.append((k, item["question"], both["RAG"].answer, both["GraphRAG"].answer))
        means = {r["system"]: {"cite_hit": r["cite_hit"], "expected_recall": r["expected_recall"]} for r in evaluate.answer_report(self.spark.createDataFrame(graded, "system string, cite_hit boolean, expected_recall double")).collect()}
        tally = {"RAG": 0, "GraphRAG": 0, "tie": 0}
        if judge and n and (self.judge or self.chat):
            model = self.judge or self.chat
            prompts = evaluate.judge_prompts(self.spark.createDataFrame(shown, "ord int, question string, first string, second string")).orderBy("ord").collect()
            said = [(r["ord"], model.chat([{"role": "system", "content": evaluate.JUDGE}, {"role": "user", "content": r["prompt"]}])) for r in prompts]
            won = evaluate.judge_tally(self.spark.createDataFrame(said, "ord int, reply string")).first()
            tally = {"RAG": won["first"], "GraphRAG": won["second"], "tie": won["tie"]}
        return {"questions": n, "judged": judge, "grounding": {s: means.get(s, {"cite_hit": 0.0, "expected_recall": 0.0}) for s in ("RAG", "GraphRAG")}, "tally": tally}

    def start_answer_eval(self, path: str, **kw) -> dict:
        """Runs ``answer_eval`` beside the service; ``job`` says how it stands. One at a time."""
        with self.lock:
            if self.job["state"] == "running":
                return self.job
            self.job = {"state": "running"}

        def run():
            try:
                self.job = {"state": "done", "report": self.answer_eval(path, **kw)}
            except Exception as e:  # noqa: BLE001  the job's state tells it
                self.job = {"state": "failed", "error": str(e)}

        threading.Thread(target=run, daemon=True).start()
        return self.job

    def eval_sets(self) -> dict[str, str]:
        """Sets of questions below the folder, by name."""
        return {p.stem: str(p) for p in sorted(self.folder.glob("eval/*.jsonl"))}

    def say(self, message: str) -> dict:
        """Goes on with the wiki's one conversation: the reply, and the calls made for it."""
        self.history.append({"role": "user", "content": message})
        *made, last = agent.converse(self.chat, self.librarian, self.history)
        return {"reply": last["reply"], "calls": [{k: c[k] for k in ("tool", "arguments", "result")} for c in made]}

    def rpc(self) -> dict:
        return agent.rpc_methods(self.librarian, (lambda q: self.ask(q).text()) if self.chat else None)

    def get(self, path: str, query: dict) -> object:
        """What GET /api/... gives."""
        name, _, rest = path.removeprefix("/api/").partition("/")
        if name == "wiki":
            return [r.asDict() for r in wiki_files.read_manifest(self.spark, str(self.folder / "wiki")).collect()]
        if name == "project":
            return {"folder": str(self.folder), "index": self.index is not None, "graph": self.graph is not None, "chat": getattr(self.chat, "name", None)}
        if name == "pages":
            ok, text = self.librarian.serve([("read_page", {"slug": rest})])[0]
            if not ok:
                raise KeyError(rest)
            return {"slug": rest, "markdown": text}
        if name == "eval-sets":
            return sorted(self.eval_sets())
        if name == "eval":
            return self.run_eval(self.eval_sets()[query["set"]], query.get("top_k"), query.get("expand_k"))
        if name == "answer-eval":
            return self.job
        if name == "health":
            return self.graph.health()
        if name == "graph":
            kind, _, slug = rest.partition("/")
            return self.graph.stats() if kind == "stats" else self.graph.explore(slug) if kind == "explore" else self.graph.neighborhood(slug or kind)
        raise LookupError(path)

    def post(self, path: str, body: dict) -> object:
        """What POST /api/... gives."""
        name = path.removeprefix("/api/")
        if name == "search":
            found = self.index.search(str(body["query"]), retrieve.clamped(body.get("k"), 0)[0])
            rows = found.withColumn("text", snippet(F.col("text"), 240)).collect()
            return [r.asDict() for r in rows]
        if name == "chat":
            with self.lock:
                return self.say(str(body["message"]))
        if name == "compare":
            return self.compare(str(body["question"]), body.get("top_k"), body.get("expand_k"), bool(body.get("answers", True)))
        if name == "answer-eval":
            return self.start_answer_eval(self.eval_sets()[body["set"]], **{k: body[k] for k in ("top_k", "expand_k", "judge", "limit") if k in body})
        if name == "graph/expand":
            return self.graph.expand(body.get("kind", "page"), str(body["id"]))
        raise LookupError(path)


class Handler(BaseHTTPRequestHandler):
    def __init__(self, wiki: Wiki, *args):
        self.wiki = wiki
        super().__init__(*args)

    def _reply(self, make) -> None:
        try:
            status, data = 200, make()
        except LookupError as e:
            status, data = 404, {"error": f"not found: {e}"}
        except Exception as e:  # noqa: BLE001  a request that fails is answered
            status, data = 500, {"error": str(e)}
        raw = json.dumps(data, ensure_ascii=False, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json; charset=utf-8")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self) -> None:  # noqa: N802
        at = urlsplit(self.path)
        self._reply(lambda: self.wiki.get(unquote(at.path), {k: v[0] for k, v in parse_qs(at.query).items()}))

    def do_POST(self) -> None:  # noqa: N802
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self._reply(lambda: self.wiki.post(urlsplit(self.path).path, json.loads(raw or b"{}")))

    def log_message(self, *args) -> None:
        pass


def http_server(wiki: Wiki, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), partial(Handler, wiki))


def build_wiki(spark: SparkSession, sources: list[str], folder: str, embedder, split_level: int = 2, size: int = 180, overlap: int = 30, similar_k: int = 6, title: str = "", chat=None, types=None, steps=("wiki", "index", "graph"), max_pages: int | None = None) -> dict:
    """Sources to a wiki's files, index and graph below folder; stages that aren't in steps are left as they are. Gives counts."""
    docs = documents.parse_source(spark, sources[0], max_pages)
    for s in sources[1:]:
        docs = docs + documents.parse_source(spark, s, max_pages)
    docs = docs.with_outline()
    pages, outline = written(docs.pages, "pages"), written(docs.outline, "outline")
    offsets = cross.page_offsets(pages)
    references_in = (pages, outline, offsets)
    many = len(sources) > 1
    pages, outline = restructure.merge(pages, outline)
    name = title or (docs.meta.first()["title"] if not many else Path(folder).name)
    pages, outline = pages.withColumn("source", F.lit(name)) if many else pages, outline.withColumn("source", F.lit(name)) if many else outline
    if many:  # entries keep their order in the merged outline: sources in order, each below its root
        order = outline.select("*", F.monotonically_increasing_id().alias("m"))
        outline = order.withColumn("ord", F.row_number().over(restructure.Window.partitionBy("source").orderBy("page", "level", "ord", "m"))).drop("m")
    cut = restructure.cuts(outline, pages, split_level)
    tree = written(restructure.slugged(restructure.assemble(cut, pages).join(restructure.parents(cut).select("source", "i", "parent"), ["source", "i"])), "tree")
    subs = restructure.subsections(cut, outline)
    out: dict = {"documents": docs.stats()}
    if "wiki" in steps:
        out["pages"] = wiki_files.write_wiki(tree, subs, f"{folder}/wiki", name, ", ".join(sources))
    known = written(wiki_pages(tree), "wiki")
    if "index" in steps:
        out["chunks"] = Index.build(known, embedder, size, overlap).save(f"{folder}/index").chunks.count()
    if "graph" in steps:
        index = Index.load(spark, f"{folder}/index", embedder)
        refs = _merged_references(*references_in, known, many)
        found = entities.extract(known, chat, types, keep=lambda df: written(df, "replies")) if chat is not None else (None, None)
        out["graph"] = Graph.build(known, index.chunks, refs, *found, similar_k).save(f"{folder}/graph").stats()
    return out


def _merged_references(pages, outline, offsets, known, many: bool):
    """References found within each source, between the pages of the merged wiki."""
    at = restructure.merge_offsets(pages.groupBy("source").agg(F.count("*").alias("n_pages"))) if many else pages.select("source").distinct().withColumn("offset", F.lit(0)).withColumn("n_pages", F.lit(1 << 30))
    spans = known.drop("source").crossJoin(F.broadcast(at))  # a row a source: a manifest, not data
    first, last = F.greatest(F.col("page_start") - F.col("offset"), F.lit(1)), F.least(F.col("page_end") - F.col("offset"), F.col("n_pages"))
    return cross.references(pages, spans.select("source", "slug", "i", first.cast("int").alias("page_start"), last.cast("int").alias("page_end")), offsets)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, chat=None, home=None) -> int:
    """init, project, status, build, search, eval, ask, chat, ontology, serve, mcp."""
    home = Path(home or Path.home() / ".config" / "scholia")
    p = argparse.ArgumentParser(prog="scholia")
    p.add_argument("--project")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("root")
    c = sub.add_parser("project")
    c.add_argument("action", choices=["list", "use", "add", "remove", "add-source"])
    c.add_argument("args", nargs="*")
    sub.add_parser("status")
    for name in ("build", "ingest", "build-wiki", "index", "graph-build"):
        c = sub.add_parser(name)
        c.add_argument("sources", nargs="*")
        c.add_argument("--force", action="store_true")
        c.add_argument("--embed")
        c.add_argument("--split-level", type=int)
    for name, what in (("search", "query"), ("ask", "question"), ("chat", "message"), ("eval", "set")):
        c = sub.add_parser(name)
        c.add_argument(what)
        c.add_argument("-k", type=int, default=5)
        c.add_argument("--expand", type=int, default=3)
    sub.add_parser("ontology").add_argument("-n", type=int, default=7)
    sub.add_parser("serve").add_argument("--port", type=int)
    sub.add_parser("mcp")
    a = p.parse_args(argv)
    registry, user = projects.Registry(home / "projects.toml"), projects.UserConfig(home / "config.toml")
    if a.command == "init":
        made = projects.new_project(a.root)
        registry.add(projects.title_of(made), made[projects.ROOT])
        print(f"{made[projects.ROOT]}: {projects.title_of(made)}")
        return 0
    if a.command == "project" and a.action != "add-source":
        if a.action == "list":
            print("\n".join(f"{'*' if n == registry.active else ' '} {n}  {r}" for n, r in registry.projects.items()))
        else:
            getattr(registry, a.action)(*a.args)
        return 0
    here = projects.current_project(a.project, registry)
    if here is None:
        print("no project here; name one with --project, or make one with init", file=sys.stderr)
        return 2
    if a.command == "project":
        for path in a.args:
            here = projects.with_source(here, path, "web" if documents.is_url(path) else "code" if (here[projects.ROOT] / path).is_dir() else (Path(path).suffix or ".md")[1:])
        return 0
    of = lambda section, key, default=None, flag=None: projects.setting(section, key, default, flag, here, user)
    settings = {"split_level": of("wiki", "split_level", 2, getattr(a, "split_level", None)), "chunk_size": of("index", "chunk_size", 180), "overlap": of("index", "overlap", 30), "embed": of("models", "embed", "hash:256", getattr(a, "embed", None)), "similar_k": of("graph", "similar_k", 6)}
    todo, now = projects.stages_to_run(here, settings, force=bool(getattr(a, "force", False)))
    if a.command == "status":
        state = projects.state_of(here)
        for stage in projects.build.STAGES:
            print(f"{stage}: {'missing' if stage not in state.stages else 'stale' if stage in todo else 'up to date'}")
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    out = projects.output_of(here)
    folder = str(out)
    if a.command in ("build", "ingest", "build-wiki", "index", "graph-build"):
        steps = {"build": ("ingest", "wiki", "index", "graph"), "ingest": ("ingest",), "build-wiki": ("wiki",), "index": ("index",), "graph-build": ("graph",)}[a.command]
        run = [s for s in steps if s in todo or a.command != "build"]
        if run:
            sources = documents.expand_sources(a.sources or projects.sources_of(here))
            got = build_wiki(spark, sources, folder, embedder_of(settings["embed"]), settings["split_level"], settings["chunk_size"], settings["overlap"], settings["similar_k"], projects.title_of(here), steps=run)
            state = projects.state_of(here)
            for s in run:
                state.record(s, now[s], str(out if s == "ingest" else out / s))
            print(json.dumps(got, default=str))
        return 0
    wiki = Wiki(spark, folder, chat, embedder_of(settings["embed"]))
    if a.command == "search":
        print(wiki.librarian.serve([("search_wiki", {"query": a.query, "k": a.k})])[0][1])
    elif a.command == "ask":
        print(wiki.ask(a.question, a.k, a.expand).text())
    elif a.command == "chat":
        print(wiki.say(a.message)["reply"])
    elif a.command == "eval":
        print(json.dumps(wiki.run_eval(wiki.eval_sets().get(a.set, a.set), a.k, a.expand), default=str))
    elif a.command == "ontology":
        texts = wiki_files.read_pages(spark, f"{folder}/wiki").select(F.lit(projects.title_of(here)).alias("source"), F.col("slug").alias("ord"), "text")
        drawn = sample.sample_corpus(texts).first()
        print("\n".join(lines_of(entities.propose_types(chat, drawn["sample"] if drawn else "", a.n))))
    elif a.command == "serve":
        http_server(wiki, a.port or of("serve", "port", 8000)).serve_forever()
    elif a.command == "mcp":
        agent.rpc_serve(wiki.rpc())
    return 0


#: One line about a page tree, for an agent.
summary_of = render.summary
