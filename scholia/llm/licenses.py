"""License scans (operator 7), in Spark's own expressions: a positional index of rare licence words.

A template is a licence: a label and the mandatory key phrases of its text or header. The index holds, for each key phrase, its words of highest inverse document
frequency and their places in the phrase. Of a text, the places of all index words are listed once; where all index words of a phrase are there, their places in the text, less those in the phrase,
give the starts each of them allows. What they have in common is checked against the whole key phrase. A template's label is given where all of its key phrases stand.

How it scales. Document frequencies of the licence words come from all documents, as one count a word; the index has a few
words a phrase, fixed by the templates. Then each row is done by itself: no shuffle, and nothing but the index goes to the tasks.

Cases. Null or empty text: no words, no places, null first and last, empty labels, score 0. Repeated rows each get their row.
Empty table: no rows. ``scan`` carries all columns of its input, whatever their names. Very long texts: a row's words are held at once, at some 60 bytes a word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, unused
from .nativewords import folded_words

#: Phrases and labels that every scan must find.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Licences by the phrases of their texts and headers that must all stand in a file.
TEMPLATES = (
    ("mit-text", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software")),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("bsd-2-clause", ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation")),
    ("bsd-3-clause", ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("apache-2-header", ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",)),
    ("gpl-notice", ("is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",)),
    ("lgpl-notice", ("is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",)),
    ("agpl-notice", ("under the terms of the gnu affero general public license as published by the free software foundation",)),
    ("mpl-header", ("this source code form is subject to the terms of the mozilla public license",)),
    ("unlicense", ("this is free and unencumbered software released into the public domain",)),
    ("cc0", ("to the extent possible under law", "waived all copyright and related or neighboring rights")),
    ("spdx", ("spdx license identifier",)),
    ("gpl", ("gnu general public license",)),
    ("lgpl", ("gnu lesser general public license",)),
    ("mpl", ("mozilla public license",)),
    ("cc-by", ("creative commons attribution",)),
    ("all-rights-reserved", ("all rights reserved",)),
    ("released", ("released under the",)),
    ("licensed", ("licensed under the",)),
)


def phrases_of(base, templates) -> dict[str, None]:
    return dict.fromkeys([*(p for p, _ in base), *(p for _, keys in templates for p in keys)])


def document_frequencies(docs: DataFrame, phrases) -> tuple[dict[str, int], int]:
    """In how many documents each phrase's words are, and the number of documents: one row a word comes back."""
    vocabulary = sorted({w for phrase in phrases for w in phrase.split()})
    index = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.explode(F.concat(F.array_intersect(index, folded_words(F.col("text"))), F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts, counts.get("", 0)


def positional_index(phrases, counts: dict[str, int], total: int, rare: int) -> dict[str, list[tuple[str, list[int]]]]:
    """Postings of each phrase: its ``rare`` words of highest IDF, rarest first, with their places in it."""
    idf = lambda w: math.log((1 + total) / (1 + counts.get(w, 0)))
    index = {}
    for phrase in phrases:
        words = phrase.split()
        best = sorted(set(words), key=lambda w: (-idf(w), w))[:rare]
        index[phrase] = [(w, [j for j, x in enumerate(words) if x == w]) for w in best]
    return index


def _starts(postings: list[tuple[str, list[int]]], phrase: str) -> str:
    """SQL of the phrase's starts in a text: what the postings' places have in common, checked against the whole phrase."""
    n, starts = len(phrase.split()), None
    for w, js in postings:
        one = [f"transform(filter(places, i -> words[i] = '{w}'), i -> i - {j})" for j in js]
        here = one[0] if len(one) == 1 else f"concat({', '.join(one)})"
        starts = here if starts is None else f"array_intersect({starts}, {here})"
    whole = "array(" + ", ".join(f"'{w}'" for w in phrase.split()) + ")"
    return f"filter(array_distinct({starts}), s -> s >= 0 and s + {n} <= size(words) and slice(words, s + 1, {n}) = {whole})"


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, rare: int = 3) -> DataFrame:
    """docs with n_words, and base and own: array<struct<label, key, start>> of verified places, key the number of the template's phrase. Where docs has such a name, the added one gets an underscore in front."""
    phrases = phrases_of(base, templates)
    if any(not set(p) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") for p in phrases):
        raise ValueError("key phrases are words of a-z and 0-9, one space apart")
    counts, total = document_frequencies(docs, phrases)
    index = positional_index(phrases, counts, total, rare)
    looked_up = sorted({w for postings in index.values() for w, _ in postings})
    listed = ", ".join(f"'{w}'" for w in looked_up)
    rows = docs.select(packed(docs).alias("row"), folded_words(F.col("text")).alias("words"))
    rows = rows.select("row", "words", F.array_intersect(F.array(*map(F.lit, looked_up)), F.col("words")).alias("present"))
    may = " or ".join("(" + " and ".join(f"array_contains(present, '{w}')" for w, _ in postings) + ")" for postings in index.values())
    places = F.expr(f"if({may}, filter(sequence(0, size(words) - 1), i -> words[i] in ({listed})), cast(array() as array<int>))")
    # the places of index words are listed once a row, before they are used in lambdas: an expression there would run again for each use
    rows = rows.select("row", F.inline(F.array(F.struct("words", "present", places.alias("places")))))

    def found(some) -> Column:
        each = []
        for label, key, phrase in some:
            have = " and ".join(f"array_contains(present, '{w}')" for w, _ in index[phrase])
            each.append(f"if({have}, transform({_starts(index[phrase], phrase)}, s -> struct('{label}' as label, {key} as key, s as start)), cast(array() as array<struct<label:string,key:int,start:int>>))")
        return F.expr("concat(" + ", ".join(each) + ")")

    own = [(label, k, phrase) for label, keys in templates for k, phrase in enumerate(keys)]
    return rows.select(*unpacked(docs, "row"), F.size("words").alias(unused(docs, "n_words")), found([(label, 0, p) for p, label in base]).alias(unused(docs, "base")), found(own).alias(unused(docs, "own")))


def complete(own: Column, templates=TEMPLATES) -> Column:
    """Labels of templates all of whose key phrases are among verified places."""
    keys = F.create_map(*[F.lit(x) for label, phrases in templates for x in (label, len(phrases))])
    labels = F.array_distinct(F.transform(own, lambda x: x["label"]))
    met = lambda label: F.size(F.array_distinct(F.transform(F.filter(own, lambda x: x["label"] == label), lambda x: x["key"])))
    return F.filter(labels, lambda label: met(label) == F.element_at(keys, label))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 less a half for each verified place) of docs(doc_id, text)."""
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    names = F.transform("base", lambda x: x["label"])
    return scan(docs.select("doc_id", "text"), **kw).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(names).alias("base_labels"), listed(F.concat(names, complete(F.col("own")))).alias("labels"), (1 - F.pow(F.lit(0.5), F.size("base") + F.size("own"))).alias("score"),
    )
