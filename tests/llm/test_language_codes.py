"""Codes of many languages, weights of bits, ambiguity of mixed texts."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import langid


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 24, 200, 500])
def test_codes(n):
    code = langid.codewords(n)
    cols = {tuple(c) for c in code.T}
    assert set(np.unique(code)) == {-1.0, 1.0} and len(cols) == code.shape[1] and not any(tuple(-x for x in c) in cols for c in cols) and not any(len(set(c)) == 1 for c in cols)
    least = min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(min(n, 120)), 2))
    assert least >= {2: 1, 3: 2, 5: 8}.get(n, 8 if n < 24 else 10 if n < 200 else 20), least


def test_weights_come_from_unfitted_rows(spark):
    """A bit that can't be learned counts for less; with texts at random for two of three languages that is the bit that parts them."""
    rng = random.Random(4)
    clear = lambda: " ".join(rng.choice(["qua", "que", "quo"]) for _ in range(30))
    noise = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(30))
    rows = [(i, clear() if i % 3 == 0 else noise(), "xyz"[i % 3]) for i in range(240)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    apart = model.code[model.langs.index("y")] != model.code[model.langs.index("z")]
    both = model.code[model.langs.index("x")] != model.code[model.langs.index("y")]
    hard, easy = model.trust[apart], model.trust[both & ~apart]
    assert len(easy) == 1 and easy[0] > 3 * hard.max(), (model.trust, model.code)


def test_mixed_texts_are_ambiguous(spark):
    rng = random.Random(5)
    words = {"en": "the cat and dog were there with house tree from".split(), "de": "der hund und die katze waren dort mit haus baum".split(), "fr": "le chat et chien etaient la avec maison arbre de".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    pure = [say(lang, 60) for lang in words for _ in range(10)]
    mixed = [" ".join(x for pair in zip(say("en", 40).split(), say("de", 40).split(), strict=True) for x in pair) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(pure + mixed)), "n long, text string").select(F.struct("n").alias("row"), "text")
    got = {r.row.n: r for r in langid.identify(df, model).collect()}
    assert not any(got[i].ambiguous for i in range(30)) and sum(got[i].ambiguous for i in range(30, 60)) >= 5
    assert [got[i].lang_pred for i in range(30)] == [lang for lang in words for _ in range(10)]
    gap = lambda some: np.mean([got[i].score for i in some])
    assert gap(range(30, 60)) < gap(range(30)) - 0.1


def test_very_long_text(spark):
    rows = [(i, ("the cat and the dog were there " if i % 2 else "der hund und die katze waren dort ") * 3, "en" if i % 2 else "de") for i in range(80)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = spark.createDataFrame([(1, "the dog and the cat " * 400_000), (2, "die katze und der hund " * 400_000), (3, "7 " * 1_000_000)], "n long, text string")
    got = {r.row.n: r.lang_pred for r in langid.identify(long.select(F.struct("n").alias("row"), "text"), model).collect()}
    assert got == {1: "en", 2: "de", 3: "und"}
