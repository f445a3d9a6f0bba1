"""Operators against brute force on small tables with nulls, empty and very long texts, copies and repeated rows."""

import hashlib
import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import decontam, langid, licenses, lmscore, neardup, packing, repeats, tokencounts, vptree, warc
from scholia.llm.common import words

WORDS = [f"w{i}" for i in range(60)]


def texts(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = say(60)
    out = [None, "", "  \n", "ab", "Ä" * 130, "abc" * 400, say(3000), shared, shared, say(5) + " " + shared, shared + " " + say(30)]
    base = say(80).split()
    for _ in range(6):
        x = list(base)
        x[rng.randrange(80)] = "new"
        out.append(" ".join(x))
    return out + [say(rng.randrange(1, 60)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], i) for i, t in enumerate(texts())], "doc_id long, text string, lang string, _block long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_repeats(docs, empty):
    got = {r.doc_id: tuple(r) for r in repeats.digest(docs).collect()}
    seen = set()
    for d, t in enumerate(texts()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert got[d] == (d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert repeats.digest(empty).count() == 0
    assert repeats.dedup(docs).columns == docs.columns and repeats.dedup(docs, block_bytes=500).count() == len(texts())


def test_refine():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    buf[200:300] = buf[:100]
    at = np.arange(0, 361)
    got = repeats.refine(buf, at, 40)
    raw = buf.tobytes()
    for i in at:
        same = [j for j in at if raw[j : j + 40] == raw[i : i + 40]]
        assert (got[i] < 0) == (len(same) == 1) and all(got[j] == got[i] for j in same)


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs, size=64).collect()
    bins, per = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    tok = packing.WordBpe(__import__("public_tokenizers").path("word_bpe_49k.json")).own
    for d, t in enumerate(texts()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cut = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        assert sorted(per[d]) == [(k, 64 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 64) + 3
    packed = packing.pack(spark.createDataFrame([(i, 5 + i % 50) for i in range(400)], "_salt int, length long"), size=64, salt_rows=3).collect()
    assert sorted((r._salt, r.length) for r in packed) == [(i, 5 + i % 50) for i in range(400)]
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(v)[:k]) for v in ends.values() for k, (o, _) in enumerate(sorted(v)))
    assert packing.pack_documents(empty, size=64).count() == 0


@pytest.mark.parametrize("copies", [8, 100])
def test_configuration_program(copies):
    """Most pieces are placed by configurations; no more sequences than best fit alone, and near the dual bound."""
    size, rng = 512, np.random.default_rng(6)
    hist = np.bincount(np.minimum(rng.gamma(1.2, 140, 2500).astype(int) + 2, size), minlength=size + 1)[: size + 1] * copies
    short = hist.copy()
    short[size] = 0
    columns, bound = packing.fractional_cover(short, size, 200)
    whole = packing.rounded(columns, short)
    covered = np.zeros(size + 1)
    for config, n in whole.items():
        assert sum(config) <= size
        np.add.at(covered, list(config), n)
    assert (covered <= short).all() and covered.sum() >= 0.9 * short.sum()

    def sequences(rows):
        seen = np.zeros(size + 1, np.int64)
        for x, a, b, _, _, _ in sorted(rows):
            assert a == seen[x]
            seen[x] = b
        assert (seen == hist).all()
        return max(first + -(-(b - a) // each) for _, a, b, each, first, _ in rows)

    n, best_fit = sequences(packing.plan(hist, size)), sequences(packing.plan(hist, size, rounds=0))
    least = math.ceil(bound - 1e-6) + hist[size]
    assert least <= n <= best_fit and n <= least * 1.001 + 1


@pytest.mark.parametrize("most", [300_000, 0])
def test_decontamination(spark, docs, empty, most):
    t = texts()
    items = [(1, t[7]), (2, "W3 w4"), (3, None), (4, "!!"), (5, " ".join(t[6].split()[100:109])), (6, " ".join(t[6].split()[500:525]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r) for r in decontam.digest(docs, bench, most_keys=most).collect()}
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    for d, x in enumerate(t):
        w = split(x)
        hit, ids = set(), set()
        for i, y in items:
            y = split(y)
            k = min(10, len(y))
            wins = {tuple(y[j : j + k]) for j in range(len(y) - k + 1)} if k else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    ids.add(str(i))
        assert got[d] == (d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    assert decontam.digest(empty, bench, most_keys=most).count() == 0
    assert decontam.clean(docs, bench, most_keys=most).count() == sum(not v[5] for v in got.values())
    spans = {r.doc_id: r.text for r in decontam.clean(docs, bench, remove="spans", most_keys=most).collect()}
    assert all(len(split(spans[d])) == v[1] - v[2] for d, v in got.items())


def test_neardup(docs, empty):
    got = {r.doc_id: tuple(r) for r in neardup.classes(docs, tile=200).collect()}
    t = texts()
    sets = []
    for x in t:
        w = (x or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(t)))
    for _ in t:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == {i: (i, len(sets[i]), root[i], root[i] == i) for i in range(len(t))}
    assert neardup.classes(empty).count() == 0


def test_neardup_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end"), (9, "q r s"), (3, "q r s"), (9, "u v w"), (2, "u v w"), (None, a), (None, a)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (7, 1), (9, 2), (3, 2), (2, 2), (None, None)} and len(got) == len(rows)


def test_licenses(spark, docs, empty):
    rows = [(0, "Under the MIT License. under, the mit license; Apache License, Version 2"), (1, "CC-BY-NC and all rights reserved"), (2, None), (3, "mit license the under")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 0, 8, "apache-2,mit")
    assert got[1].labels == "all-rights-reserved,cc-by-nc" and got[2].n_words == 0 and got[2].first_word is None and got[3].score == 0
    assert licenses.digest(empty).count() == 0 and licenses.digest(docs).count() == docs.count()


def _nearest(x, ids, k, every):
    for q in range(len(x)):
        if ids[q] % every == 0 and np.isfinite(x[q]).all() and x[q].any():
            s = vptree.exact_scores(x, x[q])
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
            yield from ((int(ids[q]), r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(order))


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[5:60] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (420, [0.0] * 6), (440, [float("nan")] * 6), (460, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    short = rng.standard_normal((30, 3)).astype(np.float32)
    rows += [(500 + i, [float(v) for v in r]) for i, r in enumerate(short)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(df, k=4, shard_rows=100, query_block=5, leaf=8).collect()
    want = [*_nearest(x.astype(float), np.arange(300), 4, 20), *_nearest(short.astype(float), np.arange(500, 530), 4, 20)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert vptree.nearest(df.limit(0)).count() == 0 and vptree.nearest(df.filter("vec_id % 20 <> 0")).count() == 0
    twice = spark.createDataFrame([(20, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vptree.nearest(twice, k=4).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("scale", ["1e-10", "1e10", "1e-160", "outlier", "tiny", "mixed"])
def test_vantage_tree_is_exact_at_any_scale(scale):
    rng = np.random.default_rng(3)
    x, ids = rng.standard_normal((1500, 8)), rng.permutation(1500)
    if scale == "outlier":
        x[7] *= 1e7
    elif scale == "tiny":
        x[7] *= 1e-7
    elif scale == "mixed":
        x *= np.exp(rng.standard_normal((1500, 1)) * 9)
    else:
        x *= float(scale)
    found = vptree.Found(x[:40], ids[:40], 5)
    for tree in vptree.plant(x, ids, 5, leaf=16):
        tree.search(found, 1.0)
    got = [(int(ids[q]), r + 1, int(found.id[q, r]), float(found.score[q, r])) for q in range(40) for r in range(5)]
    assert sorted(got) == sorted(t for t in _nearest(x, ids, 5, 1) if t[0] in set(ids[:40].tolist()))


def test_vantage_tree_factor():
    """Where distances differ (three dimensions), the triangle inequality leaves most rows out; a larger factor leaves out more, and misses some."""
    x = np.random.default_rng(4).standard_normal((4000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(4000)
    exact, share, recall = None, [], []
    for factor in (1.0, 2.0, 4.0):
        found = vptree.Found(x[:100], ids[:100], 10)
        for tree in vptree.plant(x, ids, 10, leaf=16):
            tree.search(found, factor)
        exact = found.id if exact is None else exact
        share.append(found.computed / 400_000)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.id, exact, strict=True)]))
    assert share[0] < 0.2 and share[0] > share[1] > share[2] and recall[0] == 1 and recall[1] > 0.9


def test_warc(spark):
    rows = [(1, "http://www.b.example.com/x?y", "z" * 200), (2, "http://a.example.com/", "z" * 200), (3, None, None), (4, "http://b.example.com/x?y", "é" * 20), (5, "odd\nurl", "z" * 200), (6, "q", "é" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df, block_rows=2).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(k for k, _, x in rows if x == h) if len(b) >= 100 else i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    archive = warc.write(df, warc.table_path(spark, "t"), block_rows=2)
    assert sorted(r.page_id for r in archive.lookup(["http://b.example.com/x?y", "http://none.example.com/"]).collect()) == [1, 4]
    assert warc.url_key("http://www.a.example.com/p") == "com,example,a)/p"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_token_counts(docs, empty):
    import public_tokenizers

    model = tokencounts.Unigram(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(word):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + model.unknown, best[e - 1][1] + 1)]
            options += [(best[b][0] + model.score[word[b:e]], best[b][1] + 1) for b in range(e) if word[b:e] in model.score]
            best[e] = max(options, key=lambda x: (x[0], -x[1]))
        return best[-1]

    for r in tokencounts.token_counts(docs).collect():
        each = [brute(tokencounts.MARK + w.encode()) for w in (texts()[r.doc_id] or "").split()]
        assert (r.n_words, r.n_tokens) == (len(each), sum(n for _, n in each)) and abs(r.score - sum(s for s, _ in each)) < 1e-6
    assert tokencounts.token_counts(empty).count() == 0


def test_lm(docs, empty):
    net, vocab = lmscore.fit(docs, classes=8, width=4)
    p = [net.log_probabilities(np.full((4, 1), 3), np.array([k])) for k in range(1, 65)]
    assert abs(np.exp(np.concatenate(p)).sum() - 1) < 1e-4
    rows = {r.doc_id: r for r in lmscore.score(docs, net, vocab).collect()}
    t = texts()[20]
    buf = np.frombuffer(t.encode(), np.uint8)
    from scholia.llm.common import words

    ids = vocab.ids(words(buf, np.array([0, len(buf)]))[2])
    pad = [0, 0, *ids, 0, 0]
    one = sum(float(net.log_probabilities(np.array([[pad[i]], [pad[i + 1]], [pad[i + 3]], [pad[i + 4]]]), ids[i : i + 1])[0]) for i in range(len(ids)))
    assert abs(rows[20].log_probability - one) < 1e-3 and rows[0].n_words == 0 and rows[0].mean_log_probability is None
    assert lmscore.fit_and_score(empty, classes=8, width=4).count() == 0


def test_lm_learns_from_both_sides(spark):
    """On texts it wasn't trained on, the network gives words more probability than their frequencies do."""
    rng = random.Random(5)
    pairs = [(f"a{i}", f"b{i}") for i in range(12)]
    say = lambda: " ".join(f"{x} of {y}" for x, y in rng.choices(pairs, k=40))
    df = spark.createDataFrame([(i, say()) for i in range(400)], "doc_id long, text string").repartition(2).cache()
    net, vocab = lmscore.fit(df.filter("doc_id >= 40"), classes=8, width=8, batch_words=128, rate=0.3)
    held = lmscore.score(df.filter("doc_id < 40"), net, vocab).agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    by_frequency = (math.log(1 / 3) + 2 * math.log(1 / 36)) / 3
    assert held > by_frequency + 0.7, (held, by_frequency)


def test_lm_trains_on_every_word(monkeypatch):
    monkeypatch.setattr(lmscore, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    batch = pa.record_batch([pa.array(texts())], ["text"])
    model = lmscore._train(iter([batch]), pickle.dumps(lmscore.WindowNet(8, 4)), lmscore.Vocabulary(np.zeros(0, np.uint64), 8), rate=0.1, batch_words=64)
    n_words = sum(len(t.split()) for t in texts() if t)
    assert sum(x for b in model for x in b.column("weight").to_pylist()) == n_words


def test_lm_rare_words_have_their_own_share(spark):
    n = {"a": 50, "b": 40} | {f"r{i}": i + 1 for i in range(12)}
    rows = [(k, w) for k, w in enumerate(w for w in n for _ in range(n[w]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab, counts = lmscore.vocabulary(df, classes=2)
    assert counts.sum() == len(rows) and counts[:2].tolist() == [50, 40]
    got = {rows[r.doc_id][1]: r.log_probability for r in lmscore.fit_and_score(df, classes=2, width=4).collect()}
    assert 0.9 < sum(math.exp(p) for p in got.values()) <= 1.0001
    h = {w: int(words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0]) for w in n}
    for w in n:
        for v in n:
            if w > v > "c" and h[w] % 2 == h[v] % 2:
                assert abs(got[w] - got[v] - math.log(n[w] / n[v])) < 1e-4


def test_language(spark, docs, empty):
    assert {r.lang_pred for r in langid.digest(docs).filter("doc_id < 3").collect()} == {"und"}
    assert langid.digest(empty).count() == 0
    rows = [(i, ("the cat and the dog were there " if i % 2 else "der hund und die katze waren dort ") * 3, "en" if i % 2 else "de") for i in range(80)]
    got = langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got.collect())
    code = langid.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 6


def test_language_decoding(spark):
    """The winner, score and ambiguity of each text, from the model's weights by hand."""
    say = {"en": "the cat and the dog were there ", "de": "der hund und die katze waren dort ", "fr": "le chat et le chien etaient la "}
    rows = [(i, x * 3, lang) for i, (lang, x) in enumerate(list(say.items()) * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"] and model.code.shape == (3, 3)
    tests = ["the dog and der hund", "Le Chat! 42", "zzz", "katze"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(tests)], "n long, text string")
    got = {r.row.n: r for r in langid.identify(df.select(F.struct("n").alias("row"), "text"), model).collect()}
    for k, x in enumerate(tests):
        low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in x.encode())
        total, n = np.zeros(3), 0
        for width, factor, top in ((3, 2654435761, 0), (4, 2246822519, 1)):
            for i in range(len(low) - width + 1):
                total += model.w[((int.from_bytes(low[i : i + width], "little") * factor) & 0xFFFFFFFF) >> 18 | top << 14]
                n += 1
        margin = total / max(n, 1) + model.bias
        loss = [sum(math.log1p(math.exp(-m * c)) * t for m, c, t in zip(margin, code, model.trust, strict=True)) for code in model.code]
        p = np.exp(min(loss) - np.array(loss))
        p /= p.sum()
        best, second = sorted(p)[-1], sorted(p)[-2]
        assert (got[k].lang_pred, got[k].ambiguous) == (model.langs[int(p.argmax())], bool(best - second < 0.1)) and abs(got[k].score - best) < 1e-5


NAMES = "doc_id long, text string, lang string, n_chars long, row string, block long, _block long, owner string, gone string, _gone string, words string, key string, p string, starts string, folded string, x string, a string, b string, found string, hits string, items string, id string, present string, base string, own string, n_words string, score string, lang_pred string, kept string, nothing string, _salt string"


def test_clashing_columns(spark):
    """Callers' columns come back as they were, whatever their names."""
    names = [x.split()[0] for x in NAMES.split(", ")]
    kinds = {x.split()[0]: x.split()[1] for x in NAMES.split(", ")}
    shared = " ".join(f"word{i}" for i in range(40))
    own = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    text = [own[0], own[0] + " end", own[1] + " " + shared, own[2] + " " + shared, None, "12 34"]
    rows = [tuple(i if n == "doc_id" else t if n == "text" else "en" if n == "lang" else 7 if kinds[n] == "long" else f"{n}{i}" for n in names) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, NAMES)
    bench = spark.createDataFrame([(1, " ".join(own[1].split()[5:20]))], "item_id long, text string")

    def check(out, ids, but=()):
        assert out.columns[: len(names)] == names
        got = {r[0]: r for r in out.collect()}
        assert set(got) == set(ids)
        for i in ids:
            for k, n in enumerate(names):
                assert n in but or got[i][k] == rows[i][k], (n, got[i][k], rows[i][k])
        return got

    check(langid.keep_identified(df), {0, 1, 2, 3}, {"lang"})
    check(neardup.dedup(df), {0, 2, 3, 4, 5})
    cut = check(repeats.dedup(df), range(6), {"text", "n_chars"})
    assert cut[2].text == text[2] and shared not in cut[3].text and cut[3].n_chars == len(cut[3].text) and cut[4].text is None
    check(decontam.clean(df, bench), {0, 1, 3, 4, 5})
    spans = check(decontam.clean(df, bench, remove="spans"), range(6), {"text", "n_chars"})
    assert len(spans[2].text.split()) == 85 and spans[0].text == text[0]
    check(licenses.scan(df), range(6))


def test_very_long_texts(spark):
    """A text of some megabytes goes through every operator whole."""
    rng = random.Random(8)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(200_000))
    tail = long[-500:]
    df = spark.createDataFrame([(1, long, "en"), (2, tail + " and more", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_removed for r in repeats.digest(df).collect()} == {1: 0, 2: 500}
    assert {r.doc_id: r.n_shingles for r in neardup.classes(df).collect()}[1] == 199_998
    bench = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_012]))], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontam.digest(df, bench).collect()}[1] == (200_000, 12)
    assert {r.doc_id: r.n_words for r in licenses.digest(df).collect()}[1] == 200_000
    assert {r.doc_id: r.n_words for r in tokencounts.token_counts(df).collect()}[1] == 200_000
    parts = [r for r in packing.token_pieces(df, __import__("public_tokenizers").path("word_bpe_49k.json")).collect() if r.doc_id == 1]
    assert sorted(r.start for r in parts) == list(range(0, 2048 * len(parts), 2048))
    assert {r.doc_id: r.lang_pred for r in langid.digest(df).collect()}[1] in ("en", "und")
