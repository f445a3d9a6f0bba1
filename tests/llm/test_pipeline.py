import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    say = lambda a, n: " ".join(f"{a}{i}x" for i in range(n))
    text = {i: say(chr(97 + i), 80) for i in range(8)}
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()]
    rows += [(8, text[1], "en", "s", 1), (9, None, None, "s", 0), (10, "12 34", "en", "s", 5), (11, text[2][:200] + " " + say("leak", 12), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, say("leak", 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(8))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def brute_force(docs, benchmark, langs):
    """{doc_id: text} after four stages, one after the other, in plain Python. langs: what language ID says of each document."""
    kept = {d: t for d, t in docs.items() if langs[d] != "und"}
    words = {d: re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for d, t in kept.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in words.items()}
    root = {d: d for d in kept}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {d: t for d, t in kept.items() if find(d) == d}
    seen, cut = set(), {}
    for d in sorted(kept):
        raw = kept[d].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        cut[d] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = [(min(10, len(w)), {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}) for w in map(split, benchmark) if w]
    hit = lambda w: any(tuple(w[i : i + k]) in some for k, some in windows for i in range(len(w) - k + 1))
    return {d: t for d, t in cut.items() if not hit(split(t))}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    stems = {"en": ["the", "and", "with", "house", "water", "river"], "de": ["der", "und", "mit", "haus", "wasser", "fluß"]}
    say = lambda lang, n: " ".join(rng.choice(stems[lang]) + str(rng.randrange(60)) * (rng.random() < 0.7) for _ in range(n))
    texts, langs = {}, {}
    passage, item = say("en", 60), say("de", 30)
    for d in range(60):
        lang = "en" if d % 2 else "de"
        texts[d], langs[d] = say(lang, rng.randrange(3, 160)), lang
    for d in range(60, 75):  # near and exact copies
        w = texts[d - 60].split()
        w[rng.randrange(len(w))] = "new" if d % 3 else w[0]
        texts[d], langs[d] = " ".join(w), langs[d - 60]
    for d in range(75, 85):  # shared passages, leaks
        texts[d], langs[d] = say("en", 40) + " " + passage + " " + say("en", 30) + "é", "en"
        if d % 2:
            texts[d] += " " + " ".join(item.split()[d - 75 : d - 75 + (12 if d % 4 == 1 else 9)])
    texts |= {85: None, 86: "", 87: "12 34 !!", 88: (long := say("en", 3000)), 89: long + " end"}
    langs |= {85: None, 86: "en", 87: "de", 88: "en", 89: "en"}
    rows = [(d, t, langs[d], "s", len(t or "")) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = [item, "no such words", None]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    letters = {d: "x" if re.search(r"[^\W\d_]", t or "") else "und" for d, t in texts.items()}
    left = brute_force({d: t or "" for d, t in texts.items()}, [t or "" for t in bench], letters)
    assert 50 < len(left) < 80 and any(left[d] != texts[d] for d in left)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in left.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want |= {(d, s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in places.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    assert len(places) == -(-sum(r.length for r in got) // 2048)
