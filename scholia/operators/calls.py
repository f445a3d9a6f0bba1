"""Tables of tool calls, answered by joins: what agents ask of a wiki, many calls at once, whoever made them.

``calls`` has call_id, tool and args (map<string, string>); an answer has call_id, ok and result, which is JSON where it holds more than a sentence. Calls that read are answered by ``answer``, each tool by one
job over all its calls. Calls that write are rows of an edit table (``edits``), applied by ``operators.edit``; a batch takes one change a page and says so of the others.

Cases. Unknown tools, arguments that are missing or aren't numbers where numbers are asked for, pages that aren't there: ok is false and the result says why. Null args: none. Repeated call_ids are answered once each. No calls: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import numbered
from ..functions.tables import written
from ..functions.text import first_heading, snippet
from . import edit, graph, retrieve
from .index import Index
from .knowledge import Graph

#: Tools, with the arguments that each must have, those that it may have, and the part of a shelf that it needs.
TOOLS = {
    "search_wiki": (("query",), ("k",), "index"),
    "list_pages": ((), ("sheet",), None),
    "read_page": (("slug",), (), None),
    "edit_page": (("slug", "old_text", "new_text"), (), None),
    "append_section": (("slug", "heading", "body"), (), None),
    "create_page": (("slug", "title", "body"), (), None),
    "graph_neighbors": (("slug",), (), "graph"),
    "find_path": (("from_slug", "to_slug"), (), "graph"),
    "find_entity": (("name",), (), "entities"),
}
WRITES = {"edit_page": "edit", "append_section": "append", "create_page": "create"}
#: Pages on a sheet of the list, hits of a search at most, pages of an entity at most, names of entities in a batch that are matched by substring.
SHEET, MOST_HITS, MOST_PAGES, MOST_NAMES = 100, 20, 20, 1000


@dataclass
class Shelf:
    """A wiki as tables: pages(slug, text), and an index and a graph where there are such."""

    pages: DataFrame
    index: Index | None = None
    graph: Graph | None = None

    def has(self, part: str | None) -> bool:
        return part is None or getattr(self, "graph" if part == "entities" else part) is not None and (part != "entities" or self.graph.has_entities())

    def tools(self) -> dict[str, tuple]:
        return {name: about for name, about in TOOLS.items() if self.has(about[2])}


def _arg(name: str) -> Column:
    return F.try_element_at("args", F.lit(name))


def _said(ok: Column | bool, result: Column) -> list[Column]:
    return ["call_id", (F.lit(ok) if isinstance(ok, bool) else ok).alias("ok"), result.alias("result")]


def sorted_out(calls: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Calls that can be made, and answers to the others."""
    known = shelf.tools()
    lacking = F.array().cast("array<string>")
    for name, (must, _, _) in known.items():
        none = F.array_compact(F.array(*[F.when(_arg(a).isNull(), F.lit(a)) for a in must])) if must else F.array().cast("array<string>")
        lacking = F.when(F.col("tool") == name, none).otherwise(lacking)
    is_known = F.coalesce(F.col("tool").isin(*known), F.lit(False))
    rows = calls.select("call_id", "tool", F.coalesce("args", F.create_map().cast("map<string,string>")).alias("args")).withColumn("lacking", lacking).withColumn("known", is_known)
    why = F.when(~F.col("known"), F.concat(F.lit("no tool of that name here: "), F.coalesce("tool", F.lit("(none)")))).otherwise(F.concat(F.col("tool"), F.lit(" also takes: "), F.array_join("lacking", ", ")))
    fine = F.col("known") & (F.size("lacking") == 0)
    return rows.filter(fine).select("call_id", "tool", "args"), rows.filter(~fine).select(*_said(False, why))


def _titles(shelf: Shelf) -> DataFrame:
    return shelf.pages.select("slug", F.coalesce(F.nullif(first_heading(F.col("text")), F.lit("")), "slug").alias("title"))


def _searched(mine: DataFrame, shelf: Shelf) -> DataFrame:
    asked = shelf.index.questions(mine.select(F.col("call_id").alias("qid"), _arg("query").alias("question")))
    found = shelf.index.retrieved(retrieve.seeds(written(asked, "questions"), shelf.index.chunks, MOST_HITS))
    k = F.greatest(F.lit(1), F.coalesce(F.try_to_number(_arg("k"), F.lit("999")).cast("int"), F.lit(5)))
    hit = F.struct("marker", F.struct(F.round("score", 3).alias("score"), F.col("page").alias("slug"), "title", "page_start", "page_end", snippet(F.col("text")).alias("excerpt")).alias("hit"))
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # MOST_HITS at most
    cut = F.transform(F.slice("hits", F.lit(1), k), lambda h: h["hit"])
    return mine.join(lists, F.col("qid") == F.col("call_id"), "left").select(*_said(True, F.coalesce(F.to_json(cut), F.lit("[]"))))


def _listed(mine: DataFrame, shelf: Shelf) -> DataFrame:
    sheets = numbered(_titles(shelf), [], ["slug"], "n").withColumn("sheet", F.floor((F.col("n") - 1) / SHEET).cast("int") + 1)
    lists = sheets.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("slug", "title"))).alias("pages"))
    asked = mine.withColumn("wanted", F.coalesce(F.try_to_number(_arg("sheet"), F.lit("999999")).cast("int"), F.lit(1)))
    there = F.col("pages").isNotNull() | (F.col("wanted") == 1)
    return asked.join(lists, F.col("sheet") == F.col("wanted"), "left").select(*_said(there, F.when(there, F.coalesce(F.to_json("pages"), F.lit("[]"))).otherwise("the list has no such sheet")))


def _read(mine: DataFrame, shelf: Shelf) -> DataFrame:
    asked = mine.select("call_id", _arg("slug").alias("slug")).join(shelf.pages.select("slug", "text"), "slug", "left")
    return asked.select(*_said(F.col("text").isNotNull(), F.coalesce("text", F.concat(F.lit("not a page of this wiki: "), "slug"))))


def _near(mine: DataFrame, shelf: Shelf) -> DataFrame:
    asked = written(mine.select("call_id", _arg("slug").alias("slug")).join(shelf.graph.pages.select("slug", F.lit(True).alias("there")), "slug", "left"), "asked")
    near = graph.neighborhood(shelf.graph.edges, shelf.graph.mentions, asked.select(F.col("slug").alias("page")).distinct())
    named = near.join(shelf.graph.pages.select(F.col("slug").alias("node"), "title"), "node")
    lists = named.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rel", F.col("node").alias("slug"), "title"))).alias("near"))
    return asked.join(lists, F.col("src") == F.col("slug"), "left").select(*_said(F.col("there").isNotNull(), F.when(F.col("there").isNull(), F.concat(F.lit("not in the graph: "), "slug")).otherwise(F.coalesce(F.to_json("near"), F.lit("[]")))))


def _path(mine: DataFrame, shelf: Shelf) -> DataFrame:
    ends = mine.select("call_id", _arg("from_slug").alias("a"), _arg("to_slug").alias("b"))
    for end in ("a", "b"):
        ends = ends.join(shelf.graph.pages.select(F.col("slug").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    ends = written(ends, "ends")
    found = graph.paths(shelf.graph.edges, ends.filter("has_a AND has_b").select("a", "b"))
    gone = F.concat_ws(", ", F.when(F.col("has_a").isNull(), F.col("a")), F.when(F.col("has_b").isNull(), F.col("b")))
    text = F.when(gone != "", F.concat(F.lit("not in the graph: "), gone)).when(F.col("hops").isNull(), F.lit("these pages are more than five steps apart")).otherwise(F.to_json(F.struct("hops", "nodes", "rels")))
    return ends.join(found, ["a", "b"], "left").select(*_said(gone == "", text))


def _entity(mine: DataFrame, shelf: Shelf) -> DataFrame:
    names = written(mine.select(F.lower(_arg("name")).alias("part")).distinct(), "names")
    if names.count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in one batch")
    # names are matched inside others, so there is no key to join by; of the two sides one has MOST_NAMES rows at most
    some = shelf.graph.entities.join(F.broadcast(names), F.contains(F.lower("name"), F.col("part")))
    rows = shelf.graph.mentions.join(some, F.col("entity") == F.col("key")).join(shelf.graph.pages.select(F.col("slug").alias("page"), "title"), "page")
    w = Window.partitionBy("part").orderBy("name", "type", "page")
    rows = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MOST_PAGES)
    lists = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("r", "name", "type", F.col("page").alias("slug"), "title"))).alias("found"))
    shown = F.transform("found", lambda x: x.dropFields("r"))
    return mine.withColumn("asked", F.lower(_arg("name"))).join(lists, F.col("part") == F.col("asked"), "left").select(*_said(F.col("found").isNotNull(), F.coalesce(F.to_json(shown), F.lit("nothing in the graph is called so"))))


_READS = {"search_wiki": _searched, "list_pages": _listed, "read_page": _read, "graph_neighbors": _near, "find_path": _path, "find_entity": _entity}


def answer(calls: DataFrame, shelf: Shelf) -> DataFrame:
    """call_id, ok, result of the calls that read, and of those that can't be made."""
    fine, out = sorted_out(calls, shelf)
    fine = written(fine.filter(~F.col("tool").isin(*WRITES)), "calls")
    for name in [r["tool"] for r in fine.select("tool").distinct().collect()]:  # at most as many as there are tools
        out = out.unionByName(_READS[name](fine.filter(F.col("tool") == name), shelf))
    return out


def edits(calls: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Of the calls that write: call_id, ok, result; and slug, text of the pages as they are after the calls that are ok. Nothing is written here: the pages go to a store, or to files."""
    fine = sorted_out(calls, shelf)[0].filter(F.col("tool").isin(*WRITES))
    pick = lambda *names: F.coalesce(*[_arg(n) for n in names])
    kind = F.create_map(*[F.lit(x) for pair in WRITES.items() for x in pair])[F.col("tool")]
    rows = fine.select("call_id", "tool", _arg("slug").alias("slug"), kind.alias("kind"), pick("old_text", "heading", "title").alias("old"), pick("new_text", "body").alias("new"))
    rows = written(rows.withColumn("turn", F.row_number().over(Window.partitionBy("slug").orderBy("call_id"))), "edits")
    done = written(edit.apply_edits(shelf.pages, rows.filter("turn = 1").select("slug", "kind", "old", "new")), "edited")
    text = F.when(F.col("turn") > 1, F.lit("another call of this batch changes the page; make this one again")).when(F.col("status") == "ok", F.concat(F.lit("changed "), "slug")).otherwise(F.concat("slug", F.lit(": "), "status"))
    said = rows.join(done, "slug", "left").select(*_said((F.col("turn") == 1) & (F.col("status") == "ok"), text))
    return said, done.filter("status = 'ok'").select("slug", "text")
