"""Entities come from whole texts, however long: nothing behind the first characters is left out."""

import json
import re

import duckdb
import pytest

from scholia.operators import entities
from scholia.plans import catalog


def test_parts_cover_a_text_and_cut_no_word():
    for text in ("", "a", " ".join(f"w{i}" for i in range(90)) + " ", "x" * 500, "ab " + "y" * 300 + " cd ef", "　".join(f"wort{i}" for i in range(90))):
        parts = entities.parts_of(text, 40, 12)
        at = 0
        for part in parts:
            found = text.index(part, max(0, at - 60))
            assert found <= at + 1 and (found == 0 or text[found - 1].isspace()) and (found + len(part) == len(text) or text[found + len(part)].isspace())
            at = found + len(part)
        assert at == len(text) and (len(parts) == 1) == (len(text) <= 40 or not re.search(r"\s", text[40:]))


def test_names_behind_the_first_characters(spark):
    long = "Anfang " + "wort " * 4000 + "Mitte Mitten " + "z" * 9000 + "Kein " + "Ende wort " * 2 + "Schluss Mitte"
    pages = spark.createDataFrame([("a", 0, "T", long), ("b", 1, "U", "Mitten")], "slug string, i int, title string, text string")
    assert entities.page_prompts(pages).filter("slug = 'a'").first().text == long

    class Model:
        def chat(self, messages):
            text = messages[1]["content"].split("\n\n", 1)[1]
            if "Kein" in text:
                raise OSError("no model")
            return "Found: " + json.dumps([{"name": x, "type": "Feature"} for x in re.findall("[A-Z][a-z]{5,}", text)] + [7, {"name": 5}])

    things, mentions = entities.extract(pages, Model(), ["Feature"])
    assert {(r.key, r.name) for r in things.collect()} == {("Feature::anfang", "Anfang"), ("Feature::mitt", "Mitten"), ("Feature::schluss", "Schluss")}  # of the part that fails nothing
    whole, mentions = entities.extract(pages, catalog.Capitalised(), ["Feature"])
    assert {r.entity for r in mentions.filter("page = 'a'").collect()} == {"Feature::anfang", "Feature::mitt", "Feature::schluss"} and whole.count() == 3
    assert entities.one_reply(["x"]) == "x" and entities.one_reply(["", "<think>[1]</think>[", '[{"name": "\ud800a", "type": "T"}]']) == '[{"name": "?a", "type": "T"}]'


@pytest.mark.parametrize("name", ["kg_entities", "kg_edges", "kg_stats", "kg_health", "kg_neighborhood"])
def test_a_graph_of_long_texts_is_that_of_its_sql(spark, tmp_path_factory, name):
    folder = str(tmp_path_factory.getbasetemp() / "long")
    try:
        spark.read.parquet(f"{folder}/documents.parquet")
    except Exception:  # noqa: BLE001  made once
        filler = "das haus und die katze " * 500
        rows = [(i, f"Titel {i}\n{'Kernel Driver' if i % 3 else 'nur'} {filler}{'Spaeter Kernels' if i % 2 else 'Hinten'} {filler}Zuletzt{'abc'[i % 3]}", "st"[i % 2]) for i in range(18)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    got = plain(catalog.QUERIES[name](spark, folder).collect())
    assert got == plain(con.sql(catalog.SQL[name]).fetchall())
    if name == "kg_entities":
        assert {r[1] for r in got} >= {"Spaeter", "Hinten", "Zuletzta", "Zuletztb"}
