"""Graph queries over one edge table (src, dst, rel, score): neighbourhoods, shared entities, paths, statistics, health."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions.tables import file_system, new_path, written

#: Groups of a neighbourhood, in order of precedence, and how many nodes each shows.
GROUPS = (("parent", None), ("child", None), ("prev", None), ("next", None), ("references", 8), ("referenced_by", 6), ("shared_entity", 6), ("similar", 6))


def related(edges: DataFrame, shared: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """src, node, rel, grp, ord: every page's neighbours by group, before limits; of pages(page) alone, if given. shared(a, b, n): pages by the entities they share."""
    ways = []
    for rel, near, far in (("CHILD_OF", "parent", "child"), ("NEXT", "next", "prev"), ("REFERENCES", "references", "referenced_by"), ("SIMILAR_TO", "similar", None)):
        for name, src, dst in ((near, "src", "dst"), (far, "dst", "src")):
            if name:
                g = [x for x, _ in GROUPS].index(name)
                order = -F.col("score") if name == "similar" else F.lit(0.0)
                ways.append(F.when(F.col("rel") == rel, F.struct(F.col(src).alias("src"), F.col(dst).alias("node"), F.lit(name).alias("rel"), F.lit(g).alias("grp"), order.alias("ord"))))
    out = edges.select(F.explode(F.array_compact(F.array(*ways))).alias("w")).select("w.*")
    if pages is not None:
        out = out.join(pages.select(F.col("page").alias("src")), "src", "left_semi")
    shared = shared.select(F.col("a").alias("src"), F.col("b").alias("node"), F.lit("shared_entity").alias("rel"), F.lit(6).alias("grp"), (-F.col("n")).cast("double").alias("ord"))
    return out.unionByName(shared)


def neighborhood(edges: DataFrame, mentions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """src, node, rel for every page, or for pages(page): each group cut to its limit, each node in its first group."""
    r = related(edges, top_shared(mentions, dict(GROUPS)["shared_entity"], pages), pages).withColumn("k", F.row_number().over(Window.partitionBy("src", "grp").orderBy("ord", "node")))
    limit = F.lit(1 << 30)
    for g, (_, n) in enumerate(GROUPS):
        if n:
            limit = F.when(F.col("grp") == g, n).otherwise(limit)
    r = r.filter(F.col("k") <= limit)
    return r.groupBy("src", "node").agg(F.min_by("rel", "grp").alias("rel"))


def shared_entities(mentions: DataFrame, block: int = 256, pages: DataFrame | None = None) -> DataFrame:
    """a, b, n: pages that mention the same entities, and how many; a is one of pages(page), if given: then rows grow with these alone. An entity of many pages is cut into blocks of about ``block`` pages, so that no task pairs all of them."""
    m = mentions.select("page", "entity").distinct()
    many = m.groupBy("entity").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    m = m.join(many, "entity")
    asking = m if pages is None else m.join(pages.select("page"), "page", "left_semi")
    one = asking.select(F.col("page").alias("a"), "entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    two = m.select(F.col("page").alias("b"), "entity", F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int").alias("x"))
    return one.join(two, ["entity", "x"]).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def _most_shared(page: int, posts: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k numbers (below n) that stand most often in posts, but for ``page``, smaller ones first where equal, and how often."""
    if len(posts) * 8 > n:
        c = np.bincount(posts, minlength=n)
        c[page] = 0
        u = np.flatnonzero(c)
        c = c[u]
    else:
        posts = np.sort(posts)
        at = np.flatnonzero(np.r_[True, posts[1:] != posts[:-1]])
        u, c = posts[at], np.diff(np.r_[at, len(posts)])
        u, c = u[u != page], c[u != page]
    if len(c) > k:
        cut = np.partition(c, len(c) - k)[len(c) - k]
        above = np.flatnonzero(c > cut)
        at = np.sort(np.r_[above, np.flatnonzero(c == cut)[: k - len(above)]])
        u, c = u[at], c[at]
    order = np.argsort(-c, kind="stable")
    return u[order], c[order]


def _posts_of(folder: str, low: int, high: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In a task: for the pages numbered from low to high - 1, the numbers listed for their entities, each list once: flat, begin, length; and number, row: which page has which list.

    Lists are streamed from the shared folder; those that end below low or begin at high or above aren't read. whole: every page asks, so a list's own pages are the list itself. Runs of an entity of very many pages come in a
    second pass, once it is known which of these pages mention it.
    """
    fs, top = file_system(folder)
    table = ds.dataset(top, filesystem=fs, format="parquet")
    own = "posts" if whole else "mine"
    stream = lambda names, some: table.to_batches(columns=names, filter=some, batch_size=4096, batch_readahead=1, fragment_readahead=1, use_threads=False)
    near = (ds.field("first") < high) & (ds.field("last") >= low)
    flat, length, number, row = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    n = 0

    def mine(lists) -> tuple[np.ndarray, np.ndarray]:
        x = lists.flatten().to_numpy()
        at = np.flatnonzero((x >= low) & (x < high))
        return x[at], np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[at]

    for batch in stream(list(dict.fromkeys(["posts", own])), (ds.field("hub") < 0) & near):
        x, of = mine(batch.column(own))
        some, of = np.unique(of, return_inverse=True)
        posts = batch.column("posts").take(pa.array(some))
        flat.append(posts.flatten().to_numpy())
        length.append(posts.value_lengths().to_numpy())
        number.append(x)
        row.append(n + of)
        n += len(some)
    hubs: dict[int, list] = {}
    for batch in stream(["hub", own], (ds.field("hub") >= 0) & near):
        x, of = mine(batch.column(own))
        hub = batch.column("hub").to_numpy()
        for i in np.unique(of):
            hubs.setdefault(int(hub[i]), []).append(x[of == i])
    if hubs:
        for batch in stream(["hub", "posts"], ds.field("hub") >= 0):
            for hub, posts in zip(batch.column("hub").to_pylist(), batch.column("posts"), strict=True):
                for x in hubs.get(hub, ()):
                    number.append(x)
                    row.append(np.full(len(x), n))
                if hub in hubs:
                    flat.append(posts.values.to_numpy())
                    length.append(np.array([len(flat[-1])]))
                    n += 1
    size = np.concatenate(length).astype(np.int64)
    return np.concatenate(flat), np.cumsum(size) - size, size, np.concatenate(number), np.concatenate(row)


def top_shared(mentions: DataFrame, k: int = 6, pages: DataFrame | None = None, weight: int = 1 << 26, run: int = 1 << 16) -> DataFrame:
    """a, b, n: for every page, or for pages(page), the k pages of most entities in common, smaller ones first where equal; no pair but these leaves a task.

    Pages are numbered in order of their keys, and dealt to blocks of following numbers that have about ``weight`` pairs to count (a page of more is a block; with few pairs in all blocks are smaller, so that all cores have some). The
    numbers of each entity's pages are written once to the shared folder, so what is written and shuffled grows with the mentions, whatever the blocks. A block streams these lists past its pages, keeps those of their entities, and counts
    page by page in numpy: four bytes a number in memory, ``weight`` of them at most but for a single page's own. Entities of more than ``run`` pages are kept in runs of ``run`` numbers, a row each.
    """
    spark, whole = mentions.sparkSession, pages is None
    m = mentions.select("page", "entity").filter("page IS NOT NULL AND entity IS NOT NULL").distinct()
    if pages is not None:
        asked = pages.select("page").distinct()
        m = m.join(m.join(asked, "page", "left_semi").select("entity").distinct(), "entity", "left_semi")
    m = written(m, "mentions")
    keys = written(prefix.numbered(m.select("page").distinct(), [], ["page"], "_n").select("page", (F.col("_n") - 1).cast("int").alias("_n")), "numbers")
    size = keys.count()
    rows = m.join(keys if whole else keys.join(asked.withColumn("own", F.lit(True)), "page", "left"), "page").drop("page")
    if size > run:  # no entity has more pages than there are
        hubs = written(m.groupBy("entity").agg(F.count("*").alias("total")).filter(F.col("total") > run).withColumn("hub", F.monotonically_increasing_id()), "hubs")
        rows = rows.join(F.broadcast(hubs), "entity", "left")  # at most a row for ``run`` mentions
    else:
        rows = rows.withColumn("hub", F.lit(None).cast("long")).withColumn("total", F.lit(None).cast("long"))
    part = F.when(F.col("hub").isNotNull(), F.expr(f"_n div {run}")).otherwise(-1)
    rows = rows.withColumn("run", part).repartition("entity", "run").groupBy("entity", "run")
    mine = [] if whole else [F.sort_array(F.collect_list(F.when(F.col("own"), F.col("_n")))).alias("mine")]
    lists = rows.agg(F.coalesce(F.first("hub"), F.lit(-1)).alias("hub"), F.first("total").alias("total"), F.sort_array(F.collect_list("_n")).alias("posts"), *mine)
    lists = lists.filter("hub >= 0 OR size(posts) > 1").select("hub", F.coalesce("total", F.size("posts")).alias("total"), F.element_at("posts", 1).alias("first"), F.element_at("posts", -1).alias("last"), "posts", *["mine" for _ in mine])
    folder = new_path(spark, "lists")
    lists.sortWithinPartitions("hub", "first").write.option("parquet.block.size", 4 << 20).parquet(folder)
    weights = spark.read.schema(lists.schema).parquet(folder).select(F.explode("mine" if mine else "posts").alias("_n"), "total").groupBy("_n").agg(F.sum("total").alias("w"))
    weights = written(weights, "weights")
    pairs, cores = weights.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0], spark.sparkContext.defaultParallelism
    each = min(weight, max(1 << 18, -(-int(pairs) // (4 * cores))))
    starts = prefix.running_total(weights, "w", ["_n"], "_before").groupBy(F.expr(f"_before div {each}").alias("g")).agg(F.min("_n").alias("first"))
    first = np.sort(np.array([r[0] for r in starts.select("first").collect()] + [size], np.int64))  # a number a block

    def count(batches):
        for batch in batches:
            for g in batch.column("id").to_pylist():
                flat, begin, length, number, row = _posts_of(folder, first[g], first[g + 1], whole)
                order = np.argsort(number, kind="stable")
                number, row = number[order], row[order]
                at = np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)] if len(number) else np.zeros(0, int)
                out = [(np.zeros(0, int),) * 3]
                for s, e in zip(at[:-1], at[1:], strict=True):
                    b, x = begin[row[s:e]], length[row[s:e]]
                    if x.sum() > 64 * len(x):
                        posts = np.concatenate([flat[i : i + j] for i, j in zip(b, x, strict=True)])
                    else:
                        posts = flat[np.repeat(b - (np.cumsum(x) - x), x) + np.arange(x.sum())]
                    u, c = _most_shared(number[s], posts, size, k)
                    out.append((np.full(len(u), number[s]), u, c))
                a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["_a", "_b", "n"])

    blocks = len(first) - 1
    found = spark.range(0, blocks, 1, max(1, min(blocks, 1 << 13))).mapInArrow(count, "_a int, _b int, n long")
    name = lambda c: keys.select(F.col("page").alias(c), F.col("_n").alias(f"_{c}"))
    return found.join(name("a"), "_a").join(name("b"), "_b").select("a", "b", "n")


def page_entities(mentions: DataFrame, k: int = 8) -> DataFrame:
    """page, entity, n, rank: a page's entities by how many pages mention them."""
    counts = mentions.groupBy("entity").agg(F.countDistinct("page").alias("n"))
    w = Window.partitionBy("page").orderBy(F.desc("n"), "entity")
    return mentions.distinct().join(counts, "entity").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("page", "entity", "n", "rank")


def entity_hubs(mentions: DataFrame, limit: int = 12) -> DataFrame:
    return mentions.groupBy("entity").agg(F.countDistinct("page").alias("n")).orderBy(F.desc("n"), "entity").limit(limit)


def singletons(mentions: DataFrame) -> DataFrame:
    n = mentions.groupBy("entity").agg(F.countDistinct("page").alias("n"))
    return n.agg(F.count("*").alias("entities"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("singletons"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("cross_page"))


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def degrees(pages: DataFrame, edges: DataFrame, rels=("SIMILAR_TO", "REFERENCES")) -> DataFrame:
    """page, degree: edges of rels at either end; 0 for none."""
    ends = edges.filter(F.col("rel").isin(*rels)).select(F.explode(F.array("src", "dst")).alias("page")).groupBy("page").agg(F.count("*").alias("degree"))
    return pages.join(ends, "page", "left").select("page", F.coalesce("degree", F.lit(0)).alias("degree"))


def health(pages: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: pages, those without similar pages, without entities, with neither nor references, and the mean degree."""
    flag = lambda df, c, name: df.select(F.col(c).alias("page")).distinct().withColumn(name, F.lit(1))
    sim = edges.filter("rel = 'SIMILAR_TO'")
    both = lambda e: e.select(F.explode(F.array("src", "dst")).alias("src"))
    out = degrees(pages, edges).join(flag(both(sim), "src", "s"), "page", "left").join(flag(mentions, "page", "m"), "page", "left").join(flag(both(edges.filter("rel in ('SIMILAR_TO', 'REFERENCES')")), "src", "e"), "page", "left")
    none = lambda c: F.sum(F.col(c).isNull().cast("long"))
    return out.agg(F.count("*").alias("pages"), none("s").alias("no_similar"), none("m").alias("no_entities"), F.sum((F.col("m").isNull() & F.col("e").isNull()).cast("long")).alias("orphans"), F.round(F.avg("degree"), 2).alias("avg_degree"))


#: Relations between pages that a path may take.
PATH_RELATIONS = ("CHILD_OF", "NEXT", "SIMILAR_TO", "REFERENCES")


def _undirected(edges: DataFrame, rels=PATH_RELATIONS) -> DataFrame:
    """src, dst, rel in both directions: the first relation by name of each pair."""
    e = edges.filter(F.col("rel").isin(*rels)).select(F.explode(F.array(F.struct("src", "dst", "rel"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))).alias("e")).select("e.*")
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.min("rel").alias("rel"))


def find_path(edges: DataFrame, a, b, max_hops: int = 5) -> tuple[list, list] | None:
    """Nodes and relations of a shortest undirected path, the first by its nodes; None where none is short enough. One join a hop, over what was never reached; what a hop reaches is written."""
    if a == b:
        return [a], []
    both = written(_undirected(edges), "edges")
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    front = spark.createDataFrame([(a, [a], [])], f"node {kind}, path array<{kind}>, rels array<string>")
    reached = front.select("node")
    for _ in range(max_hops):
        step = front.join(both, front.node == both.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("rels", F.array("rel")).alias("rels"))
        front = written(step.join(reached, "node", "left_anti").groupBy("node").agg(F.min(F.struct("path", "rels")).alias("p")).select("node", "p.*"), "front")
        got = front.filter(F.col("node") == b).select("path", "rels").take(1)
        if got:
            return list(got[0][0]), list(got[0][1])
        if not front.take(1):
            return None
        reached = written(reached.unionByName(front.select("node")), "reached")
    return None


def paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 5) -> DataFrame:
    """a, b, hops, nodes, rels of each of pairs(a, b): a shortest undirected path, the first by its nodes; the relation of a step is the first by name. Null where none is short enough; none for a null end; 0 hops from a page to itself.

    Two frontiers for each pair, from either end, grow by turns until they meet; a node keeps the first way to it, so a frontier has a row for each pair and node. A hop is one join, by node, and is written;
    pairs that have met leave the frontiers.
    """
    both = written(_undirected(edges), "edges")
    kind = dict(both.dtypes)["src"]
    pairs = written(pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "pairs")
    begin = lambda end: pairs.select("a", "b", F.col(end).alias("node"), F.array(end).alias("path"), F.array().cast("array<string>").alias("rels"))
    front, back = begin("a"), begin("b")
    seen = {"front": front.select("a", "b", "node"), "back": back.select("a", "b", "node")}
    found = []
    for hop in range(max_hops + 1):
        if hop:
            forth = hop % 2 == 1
            now, name = (front, "front") if forth else (back, "back")
            grown = now.join(both, F.col("node") == F.col("src")).withColumn("more", F.array("dst")).withColumn("by", F.array("rel"))
            path = [F.concat("path", "more").alias("path"), F.concat("rels", "by").alias("rels")] if forth else [F.concat("more", "path").alias("path"), F.concat("by", "rels").alias("rels")]
            step = grown.select("a", "b", F.col("dst").alias("node"), *path).join(seen[name], ["a", "b", "node"], "left_anti")
            step = written(step.groupBy("a", "b", "node").agg(F.min(F.struct("path", "rels")).alias("p")).select("a", "b", "node", "p.*"), "frontier")
            seen[name] = written(seen[name].unionByName(step.select("a", "b", "node")), "seen")
            front, back = (step, back) if forth else (front, step)
        ends = back.select("a", "b", "node", F.col("path").alias("rest"), F.col("rels").alias("rest_rels"))
        whole = F.struct(F.concat("path", F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))).alias("nodes"), F.concat("rels", "rest_rels").alias("rels"))
        met = written(front.join(ends, ["a", "b", "node"]).groupBy("a", "b").agg(F.min(whole).alias("p")).select("a", "b", F.lit(hop).alias("hops"), "p.*"), "met")
        found.append(met)
        front, back = (written(x.join(met, ["a", "b"], "left_anti"), "frontier") for x in (front, back))
        if not front.take(1) or not back.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return pairs.join(out, ["a", "b"], "left").select("a", "b", "hops", F.col("nodes").cast(f"array<{kind}>").alias("nodes"), "rels")


def ancestry(children: DataFrame, most: int = 100) -> DataFrame:
    """node, ancestor, depth for all nodes of children(node, parent): the transitive closure of a forest, by a recursive query. Chains longer than ``most`` are an error. Read the other way round it gives all descendants."""
    spark = children.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(most))
    return spark.sql(
        """WITH RECURSIVE up(node, ancestor, depth) AS (
             SELECT node, parent, 1 FROM {children} WHERE parent IS NOT NULL AND node IS NOT NULL
             UNION ALL SELECT up.node, c.parent, up.depth + 1 FROM up JOIN {children} c ON c.node = up.ancestor WHERE c.parent IS NOT NULL)
           SELECT node, ancestor, depth FROM up""",
        children=written(children.select("node", "parent").distinct(), "children"),
    )


def hops(edges: DataFrame, start, max_hops: int = 5) -> DataFrame:
    """node, hops of all that a start reaches undirected."""
    both = written(_undirected(edges).select("src", "dst"), "edges")
    kind = dict(both.dtypes)["src"]
    out = edges.sparkSession.createDataFrame([(start, 0)], f"node {kind}, hops int")
    front = out
    for h in range(1, max_hops + 1):
        front = written(front.join(both, front.node == both.src).select(F.col("dst").alias("node")).distinct().join(out.select("node"), "node", "left_anti").withColumn("hops", F.lit(h)), "front")
        if not front.take(1):
            break
        out = out.unionByName(front)
    return out


def hub_pages(pages: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """The pages of highest degree."""
    return degrees(pages, edges).orderBy(F.desc("degree"), "page").limit(limit)


def orphans(pages: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """page: those without similar pages, references of either direction, and entities."""
    some = edges.filter("rel in ('SIMILAR_TO', 'REFERENCES')").select(F.explode(F.array("src", "dst")).alias("page"))
    return pages.select("page").join(some, "page", "left_anti").join(mentions, "page", "left_anti").orderBy("page")


def entity_types(entities: DataFrame) -> DataFrame:
    """type, n of entities(key, name, type), most first."""
    return entities.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two explored parts of a graph as one: the rows of both, once."""
    return one.unionByName(two).distinct()


def descendants(edges: DataFrame, start, most: int = 100) -> DataFrame:
    """node: what hangs from a page in the tree, at any depth up to ``most``."""
    tree = edges.filter("rel = 'CHILD_OF'").select(F.col("src").alias("node"), F.col("dst").alias("parent"))
    return ancestry(tree, most).filter(F.col("ancestor") == F.lit(start)).select("node").distinct()


def collapsed(edges: DataFrame, start) -> DataFrame:
    """edges without what hangs from a page."""
    gone = descendants(edges, start)
    return edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)
