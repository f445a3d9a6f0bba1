"""Nulls, repeated ids, clashing columns, very long payloads and empty tables, where other tests don't have them."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scholia.llm import licenses, packing, vptree, warc


def test_search_ignores_other_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    more = plain.select("*", *[F.lit(7).alias(c) for c in ("id", "query_id", "score", "rank", "shard", "block", "norm", "x")])
    assert sorted(map(tuple, vptree.nearest(more, k=3, shard_rows=20, leaf=4).collect())) == sorted(map(tuple, vptree.nearest(plain, k=3, shard_rows=20, leaf=4).collect()))


def test_packing_of_null_and_repeated_ids(spark):
    long = "word and " * 3000
    rows = [(None, "a b"), (None, None), (5, "same text"), (5, "same text"), (5, "another"), (6, ""), (7, long), (7, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("length", "salt", "rank", "piece", "offset")])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d or -1, s // 256, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for s in range(0, len(ids), 256)]
    got = packing.pack_documents(df, size=256).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 256 for v in places.values())


def test_packing_in_many_groups(spark):
    """Pieces of one length in many groups have a place each."""
    parts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(64).cast("long").alias("length"))
    got = packing.pack(parts, 64, salt_rows=40).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(got) == len(places) == 3000
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 64 and [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] for v in by.values())


def test_archives_of_null_and_repeated_ids(spark):
    big = "é<p>" * 2_000_000
    rows = [(None, "http://a/", "z" * 200), (1, "", "z" * 200), (1, "", "z" * 200), (2, "", "short"), (2, "", "short"), (3, None, "z" * 200), (4, "http://big/", big), (5, "http://big/", big), (6, "http://a/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("digest", "n", "first", "file", "key", "payload")])
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, block_rows=2).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((k for k, _, x in rows if x == h and k is not None), default=i) if len(b) >= 100 else i
        revisit = i is not None and first != i
        want.append((i or -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)


def test_licence_texts(spark):
    """Labels of licences by their texts, as files hold them; a text that lacks a mandatory phrase isn't one."""
    mit = """MIT License\n\nCopyright (c) 2024 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.\n
The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"""
    bsd = """Redistribution and use in source and binary forms are permitted.\n 1. Redistributions of source code must retain the above copyright notice, this\n * list of conditions and the following disclaimer.\n
2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials.\n"""
    third = "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from\n# this software without specific prior written permission."
    files = {
        mit: {"mit-text"},
        mit.replace("substantial", "some"): set(),
        bsd: {"bsd-2-clause"},
        bsd + third: {"bsd-2-clause", "bsd-3-clause"},
        '// Licensed under the Apache License, Version 2.0 (the "License"); you may not use\n// this file except in compliance with the License.': {"apache-2-header", "apache-2", "licensed"},
        "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by the Free Software Foundation": {"gpl-notice", "gpl"},
        "SPDX-License-Identifier: MPL\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"spdx", "mpl-header", "mpl"},
        "to the extent possible under law": set(),
        "To the extent possible under law, X has waived all copyright and related or neighboring rights": {"cc0"},
        "released under the MIT license. Under the MIT license": {"released", "mit"},
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(files)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(df).collect()}
    for i, labels in enumerate(files.values()):
        assert set(filter(None, got[i].labels.split(","))) == labels, (i, got[i])
    spread = licenses.scan(df.select("*", F.lit(1).alias("places"), F.lit(2).alias("words"))).filter("doc_id = 0").first()
    assert [(x.label, x.key) for x in spread.own] == [("mit-text", 0), ("mit-text", 1)] and spread.places == 1


def pipeline_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words at all in here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert pipeline_rows(spark, tmp_path, []) == []


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    say = lambda a, n: " ".join(f"{a}{i}x" for i in range(n))
    rows = [(i, say(chr(97 + i), 80), "en", "s", 1) for i in range(6)]
    rows += [(None, say("p", 70), "en", None, None), (None, say("q", 70), None, "s", 2), (2, say("c", 80), "en", "s", 1), (4, say("z", 75), "en", "s", 1)]
    got = pipeline_rows(spark, tmp_path, rows)
    count = {}
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {None: 2, 0: 1, 1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
