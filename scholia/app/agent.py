"""A chat model that asks a wiki for things: its tool calls become a table, their answers messages. The same tools for programs that speak JSON-RPC by lines."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_think
from ..operators import calls as tool_calls
from ..operators.calls import Shelf
from ..sinks import wiki as wiki_files
from ..streaming.upsert import upsert

CALLS = "call_id int, tool string, args map<string,string>"
INSTRUCTION = "This is a wiki's librarian. What the tools return is the only source; every statement names the slug it comes from. Pages are changed on request only."
GIVEN_UP = "No answer after {} rounds of tool calls."

#: What a tool is for, for models.
PURPOSES = {
    "search_wiki": "Passages that are near to a query in meaning, best first.",
    "list_pages": f"Slugs and titles in order, {tool_calls.SHEET} a sheet.",
    "read_page": "The Markdown of one page.",
    "edit_page": "Puts new_text in the place of old_text, which must occur once.",
    "append_section": "Adds a section to a page, over its footer.",
    "create_page": "Makes a page that isn't there yet.",
    "graph_neighbors": "What a page is connected to, and by which relation.",
    "find_path": "How two pages are connected, by the fewest steps.",
    "find_entity": "Where things are mentioned whose names hold a string.",
}


class Librarian:
    """One wiki's folder as a shelf, and the calls made to it."""

    def __init__(self, spark: SparkSession, folder, index=None, graph=None, embedder=None, dry_run: bool = False):
        self.spark, self.folder, self.index, self.graph, self.embedder, self.dry_run = spark, str(folder), index, graph, embedder, dry_run
        self.log: list[str] = []

    def shelf(self) -> Shelf:
        return Shelf(wiki_files.read_pages(self.spark, self.folder), self.index, self.graph)

    def serve(self, batch: list[tuple[str, dict]]) -> list[tuple[bool, str]]:
        """Answers to calls of (tool, arguments), in order. Pages that a batch changes are written, and the graph learns of them."""
        rows = [(i, name, {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in (args or {}).items() if v is not None}) for i, (name, args) in enumerate(batch)]
        table, shelf = self.spark.createDataFrame(rows, CALLS), self.shelf()
        replies = tool_calls.answer(table, shelf)
        if any(name in tool_calls.WRITES for name, _ in batch):
            said, pages = tool_calls.edits(table, shelf)
            if self.dry_run:
                said = said.withColumn("result", F.when(F.col("ok"), F.concat(F.lit("would have "), "result")).otherwise(F.col("result")))
            else:
                self.keep(pages)
            replies = replies.unionByName(said)
        found = {r["call_id"]: (r["ok"], r["result"]) for r in replies.collect()}
        self.log += [found[i][1] for i, (name, _) in enumerate(batch) if name in tool_calls.WRITES and found[i][0]]
        return [found[i] for i in range(len(batch))]

    def keep(self, pages) -> None:
        wiki_files.write_pages(pages, self.folder)
        if self.graph is not None and self.graph.writable and self.embedder is not None:
            self.graph = upsert(self.graph, pages.withColumn("title", F.lit(None).cast("string")), self.embedder)

    def listing(self) -> list[dict]:
        """The tools that this shelf has, as JSON schemas."""
        text = {"type": "string"}
        out = []
        for name, (must, may, _) in self.shelf().tools().items():
            out.append({"name": name, "description": PURPOSES[name], "schema": {"type": "object", "properties": dict.fromkeys((*must, *may), text), "required": list(must)}})
        return out


def arguments(given) -> dict:
    """A call's arguments, also where they come as JSON; none where that can't be read."""
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            return {}
    return given if isinstance(given, dict) else {}


def converse(chat, librarian: Librarian, history: list[dict], most_rounds: int = 6) -> Iterator[dict]:
    """Goes on with a conversation until the model says something without calling tools. Gives each call with its answer, then {"reply": ...}; history grows by all messages."""
    functions = [{"type": "function", "function": {"name": t["name"], "description": t["description"], "parameters": t["schema"]}} for t in librarian.listing()]
    for _ in range(most_rounds):
        message = chat.chat_raw(history, functions)
        history.append({"role": "assistant", **message})
        wanted = [(c.get("function") or {}) for c in message.get("tool_calls") or []]
        if not wanted:
            said = librarian.spark.createDataFrame([(message.get("content") or "",)], "said string")
            yield {"reply": said.select(strip_think(F.col("said"))).first()[0]}
            return
        batch = [(c.get("name") or "", arguments(c.get("arguments"))) for c in wanted]
        for (name, args), (ok, result) in zip(batch, librarian.serve(batch), strict=True):
            history.append({"role": "tool", "tool_name": name, "content": result})
            yield {"tool": name, "arguments": args, "ok": ok, "result": result}
    yield {"reply": GIVEN_UP.format(most_rounds)}


def opening(about: str = "") -> list[dict]:
    return [{"role": "system", "content": f"{INSTRUCTION}\n{about}".strip()}]


#: What the reading tools are called over JSON-RPC.
EXPOSED = {"search_wiki": "wiki_search", "list_pages": "wiki_list_pages", "read_page": "wiki_read_page", "graph_neighbors": "wiki_graph_neighbors", "find_path": "wiki_find_path", "find_entity": "wiki_find_entity"}
ASK = {"name": "wiki_ask", "description": "An answer out of the wiki, with what it rests on.", "inputSchema": {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"]}}


def rpc_methods(librarian: Librarian, ask: Callable[[str], str] | None = None, name: str = "scholia", version: str = "1") -> dict[str, Callable[[dict], dict]]:
    """JSON-RPC methods as functions of their parameters."""
    offered = [{"name": EXPOSED[t["name"]], "description": t["description"], "inputSchema": t["schema"]} for t in librarian.listing() if t["name"] in EXPOSED]
    inner = {EXPOSED[k]: k for k in EXPOSED if any(o["name"] == EXPOSED[k] for o in offered)}

    def call(params: dict) -> dict:
        tool, args = params.get("name"), params.get("arguments") or {}
        if tool == ASK["name"] and ask is not None:
            ok, text = ("question" in args, ask(str(args["question"])) if "question" in args else "wiki_ask also takes: question")
        elif tool in inner:
            ok, text = librarian.serve([(inner[tool], args)])[0]
        else:
            ok, text = False, f"no tool of that name here: {tool}"
        return {"content": [{"type": "text", "text": text}], "isError": not ok}

    return {
        "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": name, "version": version}},
        "ping": lambda p: {},
        "tools/list": lambda p: {"tools": [ASK, *offered] if ask is not None else offered},
        "tools/call": call,
    }


def rpc_reply(line: str, methods: dict[str, Callable[[dict], dict]]) -> dict | None:
    """The reply to a line, if it asks for one: requests have an id. A line that is no JSON object is passed over."""
    try:
        request = json.loads(line)
    except ValueError:
        return None
    if not isinstance(request, dict) or "id" not in request or "method" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    run = methods.get(request["method"])
    if run is None:
        return reply | {"error": {"code": -32601, "message": f"no such method: {request['method']}"}}
    try:
        return reply | {"result": run(request.get("params") or {})}
    except Exception as e:  # noqa: BLE001  a request that fails is answered, and the next one read
        return reply | {"error": {"code": -32603, "message": str(e)}}


def rpc_serve(methods: dict[str, Callable[[dict], dict]], lines=None, out=None) -> None:
    out = out or sys.stdout
    for line in lines or sys.stdin:
        reply = rpc_reply(line, methods)
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
