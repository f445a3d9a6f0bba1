"""Filter audit, Hilbert-curve shards and conversation repair against brute force on small tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import filteraudit, hilbert, repair


def words_of(text):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]


def fails(docs, doc_id, text):
    text = text or ""
    w = words_of(text)
    found = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return found + "E" * (doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs))


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    say = lambda n, k: " ".join(rng.choice(["aa", "Bb", "ccc", "dd d", "Ä#", "e|"][:k]) + str(rng.randrange(n)) for _ in range(n))
    docs = [(0, None, "a"), (1, "", None), (2, "x " * 60, ""), (3, say(70, 6), "a"), (3, say(70, 6), "a"), (None, "same", "b"), (4, "same", "b"), (5, "same", "b"), (5, "same", "b"), (6, "SAME", None), (7, "Ä" * 4000 + " $", "a")]
    docs += [(10 + i, say(rng.randrange(30, 90), rng.randrange(1, 7)), rng.choice(["a", "b", None])) for i in range(30)]
    docs += [(50 + i, docs[12 + i % 3][1], "b") for i in range(9)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_filter_audit(spark, audited):
    docs, labels = audited
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = [(s or "", d, fails(docs, d, t)) for d, t, s in docs]
    want = {}
    for part in {r[0] for r in rows}:
        mine = [(d, f) for p, d, f in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, letter in enumerate(order):
                hit = [i for i, (_, f) in enumerate(mine) if letter in f]
                new = [i for i in hit if i not in gone]
                gone |= set(new)
                shapley[letter] += len(new)
                lost = lambda marked, new=new, mine=mine: sum(mine[i][0] in marked for i in new if mine[i][0] is not None)
                want[part, "".join(order), step + 1] = [len(mine) - len(gone), len(new), len(hit) - len(new), sum(f == letter for _, f in mine), lost(good), lost(toxic)]
        for key in want:
            if key[0] == part:
                want[key].append(shapley[key[1][key[2] - 1]])
    table = spark.createDataFrame([(d, t, s, 1, 2) for d, t, s in docs], "doc_id long, text string, source string, mask int, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in filteraudit.audit(table, marks).collect()}
    assert got == want
    assert filteraudit.audit(table.limit(0), marks).count() == 0


def test_plain_changes():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filteraudit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_walk_updates_only_two_steps():
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 32))
    before = None
    for order, removed in filteraudit.walk(counts, 5):
        taken = 0
        for k, f in enumerate(order):
            hit = np.array([m >> f & 1 == 1 and not m & taken for m in range(32)])
            assert (removed[:, :, k] == counts[:, :, hit].sum(2)).all()
            taken |= 1 << f
        if before is not None:
            assert sum(a != b for a, b in zip(before, order, strict=True)) == 2
        before = order


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_all_cells_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"c{i}" for i in range(n)]
    rows = hilbert.curve(spark.createDataFrame(cells, ", ".join(f"{c} long" for c in names)), names, bits, "at").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in itertools.pairwise(rows))


def shard_docs():
    rng = random.Random(4)
    docs = [(i, "w " * rng.randrange(1, 400), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(300)]
    return [*docs, *[(7, "same", "en", "s0")] * 90, (None, None, None, None), (None, "", "fr", "s9"), (1000, "Ä" * 90_000, "de", "s1")]


def test_hilbert_shards(spark):
    docs = shard_docs()
    table = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, lang string, source string, shard int")
    got = hilbert.digest(table, 24).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    few = hilbert.digest(table.filter("doc_id < 10 and doc_id <> 7"), 24).collect()
    assert len(few) == 9 and len({r.shard for r in few}) == 9 and {r.slot for r in few} == {0}
    assert hilbert.digest(table.limit(0)).count() == 0


def test_shards_keep_rows_and_prune(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1000), rng.randrange(1000), rng.choice("abcdefgh"), "x") for i in range(4000)]
    table = spark.createDataFrame(rows, "id long, u long, v long, name string, curve string")
    placed = hilbert.place(table, ["u", "v", "name"], ["id"], 64)
    assert placed.columns == [*table.columns, "_curve", "shard", "slot"]
    hilbert.write_shards(placed, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(tuple(r) for r in back.select(*table.columns).collect()) == rows

    def touched(df, by):
        spans = df.groupBy(by).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("u", "v", "name") for f in (F.min, F.max)])
        return [spans.filter(where).count() for where in ("min_u <= 100", "max_v >= 900", "min_name <= 'b' and max_name >= 'b'")]

    by_id = table.withColumn("shard", F.expr("id * 64 div 4000"))
    assert all(a <= 40 < b for a, b in zip(touched(back, "shard"), touched(by_id, "shard"), strict=True))
    many = hilbert.place(table, ["name"], ["id"], 8, most_values=3)  # hashed, not ranked
    assert many.count() == 4000 and many.groupBy("name").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] <= 8


def cheapest(rows):
    """(cost, audit, lines) by trying everything from the end; rows: (role, text, deleted)."""
    added, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    ends = {0: (0, "", ()), 1: (6, "II", ("user:", "assistant:")), 2: (3, "I", ("assistant:",)), 3: (0, "", ())}

    def inserted(v):
        for _ in range(4):
            v = {q: min(v[q], (v[added[q]][0] + 3, "I" + v[added[q]][1], (name[added[q]] + ":", *v[added[q]][2]))) for q in v}
        return v

    v = ends
    for role, text, gone in reversed(rows):
        new = {}
        for q in range(4):
            options = [(v[q][0] + 4, "D" + v[q][1], v[q][2])]
            if not gone:
                more = 3 * (text.rstrip(" \t\n\v\f\r")[-1] not in ".!?")
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if to is not None:
                    options.append((v[to][0] + more, "K" + v[to][1], (f"{role}:{text}", *v[to][2])))
                to = added[q]
                options.append((v[to][0] + 3 + more, "R" + v[to][1], (f"{name[to]}:{text}", *v[to][2])))
            new[q] = min(options)
        v = inserted(new)
    return v[0]


def expected(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        if not text.strip(" \t\n\v\f\r"):
            fault = 0
        elif (role, text) in seen:
            fault = 1
        else:
            fault = 2 if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        marked.append((role, text, fault in (0, 1)))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(marked)
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()], [x.split(":", 1) for x in lines]


def conversations():
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Well", "", " \n", "Why? ", None, "ab:c ", "Ä."]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(100, t, "user" if t % 2 else "assistant", rng.choice(["Same.", f"text {t}.", f"cut {t}"])) for t in range(500)]  # over many ranges
    rows += [(101, 3, "user", "Same.")] * 200
    rows += [(102, 0, "user", "x" * 3_000_000), (102, 1, "assistant", "y" * 3_000_000 + ".")]
    return rows


def test_repair(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, part int").repartition(3)
    got = {r.conv_id: r for r in repair.repair(table, rows=True).collect()}
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(row)
    assert got.keys() == by.keys()
    for c, mine in by.items():
        want, lines = expected(mine)
        assert list(got[c])[1:-1] == want
        assert [list(x) for x in got[c].repaired] == lines
    assert repair.repair(table.limit(0)).count() == 0


def test_damage_and_digest(spark):
    rows = conversations()[:-2]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out = by.setdefault(c, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        out += [[t, "user" if fault == 4 else role, text]] * (2 if fault == 3 else 1)
    got = {r.conv_id: list(r)[1:] for r in repair.digest(table).collect()}
    assert got == {c: expected(r)[0] if r else [0] * 6 + ["", hashlib.sha256().hexdigest()] for c, r in by.items()}
    assert any(not r for r in by.values()) or repair.digest(table.filter("false")).count() == 0


def test_table_of_moves_is_small():
    machine, rng = repair.Automaton(), random.Random(2)
    kinds = [None, *[(i, t) for i in ("s", "u", "a", "t", "") for t in (False, True)]]
    for _ in range(300):
        machine.scan([rng.choice(kinds) for _ in range(40)], repair.END)
    assert len(machine.vectors) < 60  # lazily made, and then looked up
