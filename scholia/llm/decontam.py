"""Benchmark decontamination (operator 5), in Spark's own expressions: a hash set of the test items' n-grams, sent to all tasks.

A window is ``width`` consecutive words of an item (an item with fewer words, but not none, is one window). A document word
inside any occurrence of a window is hit.

How it scales. Documents are read once and never exploded into windows: any window of 2b - 1 or more words holds, wherever it
stands, a whole aligned block of b words of the document (b = 5 for 9 words and more). So a document's row hashes its aligned
blocks, a fifth of its words, and keeps those whose hash is in the set of the items' b-grams. Only these few blocks, each with the
words around it, meet the items' b-grams, which have the words around them too; there whole windows are compared word for word. What is sent to
the tasks is a few words for each b-gram of an item, whatever the item's length, and is sent only up to ``most_keys`` b-grams (counted with their
repetitions). Beyond that, blocks go through a join on their hash: as (text, place, hash), without the text, whose words around found blocks are looked up afterwards.
``clean`` tells texts apart by two hashes and leaves out the few that are hit; documents themselves are not shuffled unless these are many.

Cases. Null or empty text, no words: n_words 0, not contaminated. Null text or no words in an item: no windows. Null item_id: the
item marks words but has no id to list. Repeated rows of documents each get their row; repeated items count once by id. Empty tables work.
Other columns, whatever their names, are carried by ``clean``. Very long texts: a row's words are held at once, at some 60 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, unpacked
from .nativewords import exact_words, folded_words

_BLOCKS = ((9, 5), (3, 2), (1, 1))  # windows of at least so many words: block of so many


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, words, folded (words), width of its windows, block length b."""
    rows = benchmark.select("item_id", exact_words(F.col("text")).alias("words"), folded_words(F.col("text")).alias("folded")).filter("size(words) > 0")
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("words")))
    b = F.lit(1)
    for least, block in reversed(_BLOCKS):
        b = F.when(F.col("width") >= least, block).otherwise(b)
    return rows.withColumn("b", b)


def _around(words: str, place: str) -> str:
    """The words around a block: from width - b before it to as many after it; p_in is where the block begins in them."""
    return f"named_struct('ctx', slice({words}, greatest({place} - width + b, 0) + 1, {place} - greatest({place} - width + b, 0) + width), 'p_in', {place} - greatest({place} - width + b, 0))"


def _grams(items: DataFrame) -> DataFrame:
    """key, item_id, width, b, j_in, item_words: each b-gram of each item by its hash, with the item's words around it."""
    at = F.explode(F.expr("transform(sequence(0, size(folded) - b), j -> struct(j as j, xxhash64(b, slice(folded, j + 1, b)) as key))")).alias("g")
    rows = items.select("item_id", "words", "width", "b", at).select("item_id", "width", "b", "g.key", F.expr(_around("words", "g.j")).alias("a"))
    return rows.select("key", "item_id", "width", "b", F.col("a.p_in").alias("j_in"), F.col("a.ctx").alias("item_words"))


def _blocks(b: int) -> str:
    """The document's aligned blocks of b words: structs of their place and hash."""
    return f"transform(if(size(folded) >= {b}, sequence(0, int((size(folded) - {b}) / {b})), cast(array() as array<int>)), k -> struct(k * {b} as p, xxhash64({b}, slice(folded, k * {b} + 1, {b})) as key))"


def _near(width: int) -> str:
    """A document's words around the block at x.p, for windows of up to width words."""
    return f"transform(found, x -> struct(x.p as p, x.key as key, greatest(x.p - {width}, 0) as first, slice(words, greatest(x.p - {width}, 0) + 1, x.p - greatest(x.p - {width}, 0) + {width}) as near))"


def _hits(texts: DataFrame, benchmark: DataFrame, width: int, most_keys: int, every: bool) -> DataFrame:
    """texts(id, text) as id, n_words, hits array<int> (places of hit words, from 0, ascending), items array (ids of items with occurring windows). every: with a row for texts that have none, too."""
    items = _items(benchmark, width)
    grams = _grams(items)
    keys = [tuple(r) for r in grams.select("b", "key").limit(most_keys + 1).collect()]  # bounded by most_keys, repetitions and all
    few = len(keys) <= most_keys
    keys = sorted(set(keys))
    sizes = sorted({b for b, _ in keys}) if few else [r[0] for r in items.select("b").distinct().orderBy("b").collect()]
    base = texts.select("id", "text", folded_words(F.col("text")).alias("folded"))
    none = "cast(array() as array<struct<p:int,key:bigint>>)"
    if few:
        found = [f"filter({_blocks(b)}, x -> x.key in ({', '.join(f'{k}L' for c, k in keys if c == b)}))" for b in sizes]
        base = base.select("id", "text", F.size("folded").alias("n_words"), F.expr(f"concat({', '.join(found)})" if found else none).alias("found"))
        grams = F.broadcast(grams)
    else:
        flat = base.select("id", F.explode(F.expr(f"concat({', '.join(_blocks(b) for b in sizes)})")).alias("x")).select("id", "x.p", "x.key")
        met = flat.join(grams.select("key").distinct(), "key").groupBy("id").agg(F.collect_list(F.struct("p", "key")).alias("found"))
        counted = base.select("id", "text", F.size("folded").alias("n_words"))
        base = counted.join(met, "id", "left" if every else "inner").select("id", "text", "n_words", F.coalesce("found", F.expr(none)).alias("found"))
    words = F.when(F.size("found") > 0, exact_words(F.col("text")))
    # a row's words are split off once, before they are used in a lambda: an expression there would run again for each block
    base = base.select("id", F.inline(F.array(F.struct("n_words", "found", words.alias("words")))))
    if not every:
        base = base.filter("size(found) > 0")
    base = base.select("id", "n_words", F.expr(_near(width)).alias("found"))
    explode = F.explode_outer if every else F.explode
    flat = base.select("id", "n_words", explode("found").alias("x")).select("id", "n_words", "x.p", "x.key", "x.first", "x.near")
    both = flat.join(grams, "key", "left")
    starts = F.expr("""filter(transform(sequence(0, width - b), o -> p - o), s -> s >= first and s - first + width <= size(near)
        and s - p + j_in >= 0 and s - p + j_in + width <= size(item_words) and slice(near, s - first + 1, width) = slice(item_words, s - p + j_in + 1, width))""")
    both = both.withColumn("starts", F.when(F.col("width").isNotNull(), starts))
    ok = F.size("starts") > 0
    places = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("width") - 1)))
    # each block's places first: a block that many items have is one row from here on
    some = both.groupBy("id", "n_words", "p").agg(F.array_distinct(F.flatten(F.collect_set(F.when(ok, places)))).alias("h"), F.collect_set(F.when(ok, F.col("item_id"))).alias("i"))
    out = some.groupBy("id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("items"), F.max(F.size("h")).alias("any"))
    return (out if every else out.filter(F.col("any") > 0)).select("id", "n_words", "hits", "items")


def _told_apart(docs: DataFrame) -> DataFrame:
    """id and text of the distinct texts of docs: equal texts have equal hits."""
    text = F.col("text")
    return docs.select(F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.reverse(text)).alias("b")).alias("id"), text.alias("text")).filter("text is not null")


def digest(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_keys: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs(doc_id, text)."""
    rows = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("id"), "text")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return _hits(rows, benchmark, width, most_keys, every=True).select(
        "id.doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = 10, most_keys: int = 200_000) -> DataFrame:
    """docs without what is hit: whole documents, or (remove="spans") the hit words, each with the gap after it."""
    found = _hits(_told_apart(docs), benchmark, width, most_keys, every=False).select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), "hits").dropDuplicates(["a", "b"])
    text = F.col("text")
    rows = docs.select(packed(docs, "text").alias("row"), text, F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.reverse(text)).alias("b"))
    # as a table, what was found has a size that the planner knows: it is sent to all tasks if it is small, and only else are documents shuffled
    found = materialize(found.select("a", "b") if remove == "documents" else found, "hits")
    if remove == "documents":
        return rows.join(found, ["a", "b"], "left_anti").select(*unpacked(docs, "row", text=text))
    rows = rows.join(found, ["a", "b"], "left")
    parts = F.regexp_extract_all("text", F.lit(r"(?i)[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.concat(lead, F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("hits", i), x)), lambda x: x.isNotNull()), ""))
    hit = F.col("hits").isNotNull()
    own = {"text": F.when(hit, kept).otherwise(text)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(hit, F.length(kept).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return rows.select(*unpacked(docs, "row", **own))
