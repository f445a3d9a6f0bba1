"""Folders of documents as data sources: ``spark.read.format(...).load(folder)``.

| format | rows | files |
|---|---|---|
| scholia_markdown | source, ord, level, title, text: a section a heading | .md .markdown .txt |
| scholia_html | the same | .html .htm |
| scholia_parsed | source, part, number, level, title, text: a document's metadata (part meta, title), outline (part outline, number: its page) and pages (part page) | .json |
| scholia_questions | source, line, question, expected | .jsonl |

How it scales. The driver lists the folder's own entries, no deeper, and reads no file: a subfolder is a partition of its own, which its task walks; files that lie in the folder itself are dealt to partitions in order of their names.
``filesPerPartition`` (32) says how many. A task holds one file at a time and gives its rows out as they are parsed. With ``pushdown=true`` conditions on ``source`` (equal, in, begins, ends, contains) reach the reader, and
files that they leave out aren't opened. Such a table serves one query: Spark 4.1 keeps a loaded table's first conditions, also for a later query that has none, so load it anew for each. ``maxSections`` caps the sections of a document.

Cases. Names that begin with a dot or an underscore are left out. An empty folder: no rows; a missing one: an error. Bytes that aren't UTF-8 are replaced. A file without sections has no rows. JSON that can't be read is an error that names the file;
with ``mode=skip`` it is left out. Blank lines and lines that begin with # are no questions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..functions.tables import file_system
from . import html

_FENCE = re.compile(r"\s*(?:```|~~~)")
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*")


def markdown_sections(text: str) -> Iterator[tuple[int, int, str | None, str]]:
    """(ord, level, title, text): what precedes the first heading has no title; headings in fences don't count."""
    n, level, title, lines, inside = 0, 1, None, [], False
    for line in [*re.split(r"\r\n?|\n", text), None]:
        fence = line is not None and _FENCE.match(line)
        heading = None if line is None or fence or inside else _HEADING.fullmatch(line)
        if line is None or heading:
            body = "\n".join(lines).strip()
            if title is not None or body:
                yield n, level, title, body
                n += 1
            if heading:
                level, title, lines = len(heading[1]), heading[2], []
        inside ^= bool(fence)
        lines.append(line)


def html_rows(text: str) -> Iterator[tuple]:
    return html.sections(text)


@dataclass
class Files(InputPartition):
    """Files by name, or a folder to walk."""

    names: tuple[str, ...] = ()
    folder: str | None = None


@dataclass
class Condition:
    """What a pushed filter asks of a file's path."""

    kind: str
    values: tuple[str, ...]

    def holds(self, path: str) -> bool:
        tests = {"is": path.__eq__, "starts": path.startswith, "ends": path.endswith, "contains": path.__contains__}
        return any(tests[self.kind](v) for v in self.values)


_PUSHED = {EqualTo: "is", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}


class FolderReader(DataSourceReader):
    def __init__(self, source: FolderSource):
        self.root, self.suffixes = source.options["path"].rstrip("/"), source.suffixes
        self.per_partition = int(source.options.get("filesperpartition", 32))
        self.most = int(source.options["maxsections"]) if "maxsections" in source.options else None
        self.skip_bad = source.options.get("mode") == "skip"
        self.rows, self.conditions = source.rows, []

    def _taken(self, entry) -> bool:
        return entry.type == pafs.FileType.File and entry.base_name[0] not in "._" and entry.base_name.lower().endswith(self.suffixes)

    def partitions(self):
        fs, top = file_system(self.root)
        entries = sorted(fs.get_file_info(pafs.FileSelector(top)), key=lambda e: e.path)
        names = [e.base_name for e in entries if self._taken(e) and all(c.holds(f"{self.root}/{e.base_name}") for c in self.conditions)]
        flat = [Files(tuple(names[s : s + self.per_partition])) for s in range(0, len(names), self.per_partition)]
        inner = [Files(folder=e.base_name) for e in entries if e.type == pafs.FileType.Directory and e.base_name[0] not in "._"]
        return [*flat, *inner] or [Files()]

    def _paths(self, part: Files) -> Iterator[str]:
        """Paths below the root, a folder's as they are met."""
        yield from part.names
        if part.folder is not None:
            fs, top = file_system(self.root)
            folders = [f"{top}/{part.folder}"]
            while folders:
                for e in sorted(fs.get_file_info(pafs.FileSelector(folders.pop())), key=lambda e: e.path):
                    if e.type == pafs.FileType.Directory and e.base_name[0] not in "._":
                        folders.append(e.path)
                    elif self._taken(e):
                        yield e.path[len(top) + 1 :]

    def read(self, partition: Files):
        fs, top = file_system(self.root)
        for name in self._paths(partition):
            source = f"{self.root}/{name}"
            if not all(c.holds(source) for c in self.conditions):
                continue
            with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            try:
                for row in self.rows(text):
                    if self.most is not None and row[0] >= self.most:
                        break
                    yield (source, *row)
            except ValueError as e:
                if not self.skip_bad:
                    raise ValueError(f"{source}: {e}") from e


class PushedReader(FolderReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("source",) and type(f) in _PUSHED:
                self.conditions.append(Condition(_PUSHED[type(f)], (f.value,)))
            elif isinstance(f, In) and f.attribute == ("source",):
                self.conditions.append(Condition("is", tuple(v for v in f.value if v is not None)))
            else:
                yield f


class FolderSource(DataSource):
    """One format; its subclasses say which files it takes and what rows a file's text gives."""

    suffixes: tuple[str, ...] = ()
    columns = "ord int, level int, title string, text string"

    @classmethod
    def name(cls) -> str:
        return cls.format_name

    def schema(self) -> str:
        return f"source string, {self.columns}"

    def reader(self, schema) -> FolderReader:
        if "path" not in self.options:
            raise ValueError(f"{self.name()} needs a folder to load")
        return PushedReader(self) if self.options.get("pushdown") == "true" else FolderReader(self)


class MarkdownSource(FolderSource):
    format_name, suffixes, rows = "scholia_markdown", (".md", ".markdown", ".txt"), staticmethod(markdown_sections)


class HtmlSource(FolderSource):
    format_name, suffixes, rows = "scholia_html", (".html", ".htm"), staticmethod(html_rows)


def parsed_rows(text: str) -> Iterator[tuple]:
    """Rows of a parsed document; outline, pages and texts may be missing."""
    document = json.loads(text)
    if not isinstance(document, dict):
        raise ValueError("not a document")
    about = document.get("metadata") or {}
    yield 0, "meta", about.get("page_count"), None, about.get("title"), about.get("format")
    for i, o in enumerate(document.get("outline") or []):
        yield i, "outline", o.get("page", -1), o.get("level"), o.get("title"), None
    for i, p in enumerate(document.get("pages") or []):
        yield i, "page", p.get("number"), None, None, p.get("text") or ""


class ParsedSource(FolderSource):
    format_name, suffixes, rows = "scholia_parsed", (".json",), staticmethod(parsed_rows)
    columns = "ord int, part string, number int, level int, title string, text string"


def question_rows(text: str) -> Iterator[tuple]:
    for n, line in enumerate(re.split(r"\r\n?|\n", text)):
        line = line.strip()
        if line and not line.startswith("#"):
            item = json.loads(line)
            expected = item.get("pages") if item.get("pages") is not None else item.get("expected")
            expected = [] if expected is None else expected if isinstance(expected, list) else [expected]
            yield n, item.get("question"), [str(x) for x in expected]


class QuestionSource(FolderSource):
    format_name, suffixes, rows = "scholia_questions", (".jsonl",), staticmethod(question_rows)
    columns = "line int, question string, expected array<string>"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MarkdownSource, HtmlSource, ParsedSource, QuestionSource):
        spark.dataSource.register(source)
