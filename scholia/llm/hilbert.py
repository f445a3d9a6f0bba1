"""Hilbert-curve sharding (operator 12), in Spark's own expressions: rows ordered along a curve through their metadata, cut into runs.

Each dimension is quantised to ``bits`` bits between the least and largest value that the table holds; strings count by their rank among the distinct values.
The curve's index comes from a table of moves: for each level, the bits of all dimensions and the curve's orientation give the next digit and orientation. Rows that
are neighbours on the curve are neighbours in all dimensions, so a run of it has small ranges in each of them, and a file's least and largest values leave out most
files for a condition on any of them. Runs are cut by rows: shards differ by one row at most.

How it scales. Rows are dealt by ranges of (curve, ties) and sorted there. Of a hot cell, rows are told apart by the ties, and rows that are alike in these too by where
they were read, so that a range never has to hold them all. A row's place is its place in its range plus what the ranges before hold; the latter is a table of
one row a range. Distinct strings are ranked only up to ``most_values`` of them, counted; beyond that a dimension's code is its values' hash.

Cases. Null or empty text: 8 bytes in ``sizes``. Null in a dimension: code 0, with the least value; null strings have a rank of their own, the first. Repeated rows each have their place.
Empty table: no rows. Fewer rows than shards: the rows are spread over some of them, none holds two. All columns are carried, whatever their names. Texts of any length pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, quoted, shuffle_parts, unpacked, unused


def moves(n: int) -> list[int]:
    """Table of the n-dimensional curve: at ((entry * n + direction) << n) + bits stands (next entry * n + next direction) << n | digit."""
    full = (1 << n) - 1
    gray = lambda i: i ^ i >> 1
    back = {gray(i): i for i in range(1 << n)}
    left = lambda x, k: (x << k % n | x >> n - k % n) & full
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing ones
    table = []
    for entry in range(1 << n):
        for direction in range(n):
            for bits in range(1 << n):
                digit = back[left(bits ^ entry, n - (direction + 1) % n)]
                inner = gray((digit - 1) // 2 * 2) if digit else 0
                turn = (ones(digit - 1) if digit % 2 == 0 else ones(digit)) % n if digit else 0
                table.append(((entry ^ left(inner, direction + 1)) * n + (direction + turn + 1) % n) << n | digit)
    return table


def with_codes(rows: DataFrame, dims: list[str], bits: int, most_values: int) -> tuple[DataFrame, list[str]]:
    """rows and the names of one column of codes below 2^bits for each dimension."""
    names = []
    for d in dims:
        name = unused(rows, f"code_{len(names)}")
        if dict(rows.dtypes)[d] == "string":
            values = rows.select(quoted(d).alias("v")).distinct().limit(most_values + 1)
            n = values.count()
            if n > most_values:
                rows = rows.withColumn(name, F.pmod(F.xxhash64(quoted(d)), F.lit(1 << bits)))
            else:
                rank = values.select(F.col("v").alias(f"v_{name}"), F.expr(f"((row_number() OVER (ORDER BY v NULLS FIRST) - 1) * {1 << bits}L) div {max(n, 1)}").alias(name))  # most_values rows at most
                rows = rows.join(F.broadcast(rank), quoted(d).eqNullSafe(F.col(f"v_{name}")), "left").drop(f"v_{name}")
        else:
            x = quoted(d).cast("decimal(38,0)")
            low, high = rows.agg(F.min(x), F.max(x)).first()
            code = F.lit(0) if low is None else (x - F.lit(low)) * F.lit(1 << bits) / F.lit(high - low + 1)
            rows = rows.withColumn(name, F.coalesce(F.floor(code).cast("long"), F.lit(0)))
        names.append(name)
    return rows, names


def curve(rows: DataFrame, codes: list[str], bits: int, name: str) -> DataFrame:
    """rows with the curve's index of the codes; one projection a level, so that no expression is repeated."""
    n = len(codes)
    table = F.array(*[F.lit(x) for x in moves(n)])
    move, index = unused(rows, "move"), F.lit(0).cast("long")
    rows = rows.withColumn(move, F.lit(0)).withColumn(name, index)
    for level in range(bits - 1, -1, -1):
        here: Column = F.lit(0)
        for j, c in enumerate(codes):
            here = here + F.shiftleft(F.shiftright(quoted(c), level).bitwiseAND(F.lit(1)).cast("int"), j)
        rows = rows.withColumn(move, F.get(table, F.shiftleft(F.shiftright(quoted(move), n), n) + here))
        rows = rows.withColumn(name, F.shiftleft(quoted(name), n) + quoted(move).bitwiseAND(F.lit((1 << n) - 1)))
    return rows.drop(move)


def place(rows: DataFrame, dims: list[str], ties: list[str], shards: int, bits: int = 5, most_values: int = 10_000) -> DataFrame:
    """rows with curve, shard, slot (place in the shard, from 0); where rows has such a name, the added one gets an underscore in front.

    ``ties`` order rows of one cell of the curve; rows alike in these too are in no particular order.
    """
    if not 1 <= len(dims) <= 4 or not 1 <= bits * len(dims) <= 62:
        raise ValueError("one to four dimensions, 62 bits in all")
    added = [unused(rows, c) for c in ("curve", "shard", "slot")]
    keyed, codes = with_codes(rows, dims, bits, most_values)
    keyed = curve(keyed, codes, bits, added[0])
    keys = [quoted(added[0]), *[quoted(t) for t in ties]]
    keyed = keyed.select(packed(rows).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("read_at"))
    keys = [f"k{i}" for i in range(len(keys))]
    ranged = keyed.repartitionByRange(shuffle_parts(rows.sparkSession), *keys, "read_at").sortWithinPartitions(*keys, "read_at")
    ranged = materialize(ranged.select("row", "k0", F.monotonically_increasing_id().alias("at")), "ranges")  # partition << 33 | place in it
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # a row a range
    rank = F.col("before") + inside
    placed = ranged.join(F.broadcast(before), part == F.col("part")).select("row", "k0", rank.alias("rank"), "total", F.expr(f"((before + (at & 8589934591L)) * {shards}L) div total").alias("to"))
    first = F.expr(f"(`to` * total + {shards - 1}L) div {shards}L")  # least rank r with r * shards div total = to
    return placed.select(*unpacked(rows, "row"), F.col("k0").alias(added[0]), F.col("to").cast("int").alias(added[1]), (F.col("rank") - first).alias(added[2]))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes of the text plus 8), text_crc32, octaves (bits of the squared size): what a shard's order needs of docs."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8
    return docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.length(F.bin(size * size)).cast("long").alias("octaves"))


DIMS, TIES = ["lang", "source", "octaves", "doc_id"], ["text_crc32", "doc_id"]


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    placed = place(materialize(sizes(docs), "sizes"), DIMS, TIES, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Files by shard. ``place`` has left runs of the curve together, so each task writes runs and nothing is shuffled."""
    placed.sortWithinPartitions(quoted(shard), quoted(slot)).write.partitionBy(shard).parquet(path)
