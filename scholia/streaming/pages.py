"""Versions of pages as keyed state: a stream of edits in, changes of edges out.

State holds, for each page, the version that counts and the pages it links to. A later version gives ``add`` and ``remove`` for the links that differ; earlier ones and repeated ones give nothing. A page
that isn't edited for ``expire`` of event time is forgotten: a timer gives ``expire`` for each of its links and clears the state. Edits older than the watermark are left out by Spark.
``net_edges`` folds changes to edges; they equal those of ``batch_edges`` over the same edits, in whatever order and however often these came, as far as no page expired.

How it scales. State is one value and one map entry a link, kept by Spark's state store on the executor that has the key; a batch touches the state of its own pages. Changes are as many as links that differ.

Cases. Null slugs and versions are left out. Null links: none. A link from a page to itself, and repeated links, count once at most (self-links not at all). Several edits of a page in one batch: the greatest version;
of edits of one version the first in order of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "src string, dst string, change string, version long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _frame(slug: str, changed: list[tuple[str, str]], version: int) -> pd.DataFrame:
    return pd.DataFrame({"src": [slug] * len(changed), "dst": [d for d, _ in changed], "change": [c for _, c in changed], "version": pd.Series([version] * len(changed), dtype="int64")})


class PageLinks(StatefulProcessor):
    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "version long, seen long")
        self.links = handle.getMapState("links", "dst string", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, seen = None, 0
        for frame in rows:
            for version, ts, links in zip(frame["version"], frame["ts"], frame["links"], strict=True):
                links = sorted({str(x) for x in links if x is not None} - {key[0]}) if links is not None else []
                if best is None or version > best[0] or version == best[0] and links < best[1]:
                    best = version, links
                seen = max(seen, int(pd.Timestamp(ts).timestamp() * 1000))
        if best is None:
            return
        version, links = int(best[0]), set(best[1])
        held = self.current.get() if self.current.exists() else None
        seen = max(seen, held[1] if held else 0)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(seen + self.expire_ms)
        if held and version <= held[0]:
            self.current.update((held[0], seen))
            return
        before = {k[0] for k in self.links.keys()}
        for dst in before - links:
            self.links.removeKey((dst,))
        for dst in links - before:
            self.links.updateValue((dst,), (version,))
        self.current.update((version, seen))
        changed = [(d, "add") for d in sorted(links - before)] + [(d, "remove") for d in sorted(before - links)]
        if changed:
            yield _frame(key[0], changed, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.current.get() if self.current.exists() else None
        gone = [(k[0], "expire") for k in self.links.keys()]
        self.links.clear()
        self.current.clear()
        if gone:
            yield _frame(key[0], sorted(gone), held[0] if held else 0)

    def close(self) -> None:
        pass


def edge_changes(edits: DataFrame, expire_days: float = 365.0, late: str = "1 day") -> DataFrame:
    """src, dst, change (add, remove, expire), version of a stream of edits(slug, version, ts, links: array<string>). The session's state store must be RocksDB (PROVIDER)."""
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = edits.filter("slug IS NOT NULL AND version IS NOT NULL").select("slug", F.col("version").cast("long").alias("version"), "ts", "links").withWatermark("ts", late)
    return rows.groupBy("slug").transformWithStateInPandas(PageLinks(int(expire_days * 86_400_000)), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def net_edges(changes: DataFrame) -> DataFrame:
    """src, dst, version of the edges that changes leave: of each pair the last change, if it is ``add``. Partial sums by pair."""
    order = F.struct("version", F.when(F.col("change") == "add", 0).otherwise(1))
    last = changes.groupBy("src", "dst").agg(F.max_by("change", order).alias("change"), F.max_by("version", order).alias("version"))
    return last.filter("change = 'add'").select("src", "dst", "version")


def batch_edges(edits: DataFrame) -> DataFrame:
    """src, dst of the last version of each page of edits(slug, version, links)."""
    links = F.array_sort(F.array_distinct(F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != F.col("slug")))))
    rows = edits.filter("slug IS NOT NULL AND version IS NOT NULL").select("slug", F.struct((-F.col("version")).alias("v"), links.alias("links")).alias("x"))
    return rows.groupBy("slug").agg(F.min("x").alias("x")).select(F.col("slug").alias("src"), F.explode("x.links").alias("dst"))
