"""Text rules as column expressions: white space, word windows, slugs, entity names, citations, snippets."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s is ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
#: Its characters, one by one.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Articles that entity names lose.
ARTICLES = ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "einen", "einem", "the", "a", "an")
#: Letters that slugs spell out.
DIGRAPHS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(_BLANKS))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def normalize_text(text: Column) -> Column:
    """Paragraphs of single-spaced words, one a line."""
    parts = F.transform(F.split(text, r"\n[\t-\r\x1c-\x20\x85\p{Z}]*\n"), lambda x: F.array_join(words(x), " "))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def windows(text: Column, size: int = 180, overlap: int = 30) -> Column:
    """Array of word windows; the last is the first that reaches the end. The words are split off once, as a lambda's variable."""
    size = max(1, size)
    overlap = overlap if 0 <= overlap < size else size // 3
    step = max(1, size - overlap)

    def cut(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


@functools.cache
def _decomposed() -> tuple[str, str, str, str]:
    """What lower-case letters outside of ASCII are in it, by compatibility decomposition: letters that become one letter and these; of the others a JSON map, and their class."""
    one, many = {}, {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if 0xD800 <= ord(c) <= 0xDFFF or not unicodedata.decomposition(c):
            continue
        to = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(to) == 1 and to != '"' and to != "\\":
            one[c] = to
        elif to:
            many[c] = to
    spans: list[list[int]] = []  # a few ranges that hold them all: a class of single letters would be slow
    for n in sorted(map(ord, many)):
        if spans and n - spans[-1][1] < 256:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    return "".join(one), "".join(one.values()), json.dumps(many), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def slug(title: Column, longest: int = 60) -> Column:
    """Slug of a title in any script: digraphs spelt out, other letters by Unicode decomposition, the rest of the title's marks as hyphens."""
    x = F.lower(strip(F.coalesce(title, F.lit(""))))
    for a, b in DIGRAPHS:
        x = F.replace(x, F.lit(a), F.lit(b))
    ones, to, many, some = _decomposed()
    spelt = F.from_json(F.lit(many), "map<string,string>")
    x = F.translate(x, ones, to)
    x = F.when(x.rlike(some), F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(x, r"[^\x00-\x7F]", ""), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(F.left(F.regexp_replace(x, r"^-+|-+$", ""), F.lit(longest)), r"-+$", ""), r"^$", "section")


def slugify(title: str, longest: int = 60) -> str:
    x = (title or "").strip().lower()
    for a, b in DIGRAPHS:
        x = x.replace(a, b)
    x = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
    x = "-".join(filter(None, "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in x).split()))
    return x[:longest].rstrip("-") or "section"


def entity_key_name(name: Column) -> Column:
    """What spellings of one name share: no case, marks, articles, umlauts or plural ending."""
    x = F.replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s-]", " "), F.lit("-"), F.lit(" "))
    x = F.array_join(F.filter(words(x), lambda w: ~w.isin(*ARTICLES)), " ")
    x = F.replace(F.translate(x, "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    n = F.length(x)
    return F.when(F.endswith(x, F.lit("en")) & (n >= 6), F.left(x, n - 2)).when(F.endswith(x, F.lit("n")) & (n >= 5), F.left(x, n - 1)).when(F.endswith(x, F.lit("e")) & (n >= 5), F.left(x, n - 1)).otherwise(x)


def entity_name_ok(name: Column) -> Column:
    return F.length(name).between(2, 40) & ~name.rlike(r"^\d+$")


def strip_think(reply: Column) -> Column:
    return strip(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))


def citations(answer: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def verdict(reply: Column) -> Column:
    found = F.lower(F.regexp_extract(strip_think(reply), r"(?i)\b(a|b|tie)\b", 1))
    return F.when(found == "", "tie").otherwise(found)


def snippet(text: Column, longest: int = 160, mark: str = "…") -> Column:
    x = F.array_join(words(text), " ")
    return F.when(F.length(x) > longest, F.concat(F.rtrim(F.left(x, F.lit(longest))), F.lit(mark))).otherwise(x)


def first_heading(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))


def page_references(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\bSeiten?\s+(\d{1,3})\b"), F.lit(1)), lambda x: x.cast("int"))


def is_url(source: Column) -> Column:
    return F.lower(source).rlike("^https?://")


def source_type(source: Column, is_folder: Column | bool = False) -> Column:
    """web, code (a folder), pdf, text, markdown or unknown, by the form of a source's name."""
    low = F.lower(source)
    return (
        F.when(is_url(source), "web").when(is_folder if isinstance(is_folder, Column) else F.lit(is_folder), "code").when(low.rlike(r"[^/]\.html?$"), "web").when(low.rlike(r"[^/]\.pdf$"), "pdf")
        .when(low.rlike(r"[^/]\.txt$"), "text").when(low.rlike(r"[^/]\.(md|markdown)$"), "markdown").otherwise("unknown")
    )


def source_stem(source: Column) -> Column:
    """A name for what a source gives: the last part of a URL's path (its host where there is none), else a file's name without its last suffix."""
    rest = F.regexp_replace(F.regexp_replace(source, "(?i)^https?://", ""), r"[?#].*$", "")
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("page"))
    bare = F.when(F.size(parts) > 1, F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", "")).otherwise(last)
    of_url = F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w.-]+", "-"), "^-+|-+$", "")
    name = F.coalesce(F.try_element_at(F.filter(F.split(source, r"[/\\]"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    return F.when(is_url(source), F.when(of_url == "", "page").otherwise(of_url)).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def markdown_table(rows: Column) -> Column:
    """GFM table of array<array<string>>: first row is the header; short rows are padded."""
    wide = F.array_max(F.transform(rows, F.size))
    cell = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")).otherwise("")
