"""Readers over tables: Markdown, code trees, evaluation sets. Each gives one row a section, page or item. HTML is in ``html``, folders as data sources in ``formats``."""

from __future__ import annotations

import re

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions.tables import file_system, read_files
from ..functions.text import strip

def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


#: How a line that opens or closes a fence begins, and a heading.
_FENCE, _HEADING = r"[ \t\x0B\f]*(?:```|~~~)", r"^(#{1,6})\s+(.*?)\s*#*\s*$"
#: A token: a fenced block, up to the next fence of any kind or the end, or else a line.
_TOKEN = rf"(?m)^{_FENCE}[^\n]*(?s:.*?)(?:^{_FENCE}[^\n]*|\z)|^[^\n]*"


def markdown_sections(docs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """source, ord, level, title, text of docs(source, text): a section a heading; what precedes the first has no title; headings in fences don't count. max_pages: sections of a document at most.

    All within a row: its tokens, where headings stand among them, and the slices between. Nothing is shuffled.
    """
    text = F.concat(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\n"))
    tokens = docs.select("source", F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("t")).filter("size(t) > 0")
    is_head = lambda i: F.get("t", i).rlike(_HEADING) & ~F.get("t", i).rlike(f"^{_FENCE}")
    heads = F.filter(F.sequence(F.lit(0), F.size("t") - 1), is_head)
    starts = tokens.select("source", "t", F.concat(F.array(F.lit(-1)), heads, F.array(F.size("t"))).alias("s"))  # -1: what precedes the first heading

    def section(k: Column) -> Column:
        at, first = F.get("s", k), F.greatest(F.get("s", k), F.lit(0))
        head = F.when(at >= 0, F.get("t", at))
        body = strip(F.array_join(F.slice("t", first + 1, F.get("s", k + 1) - first), "\n"))
        return F.struct(F.coalesce(F.length(F.regexp_extract(head, _HEADING, 1)), F.lit(1)).alias("level"), F.regexp_extract(head, _HEADING, 2).alias("title"), body.alias("text"))

    each = F.transform(F.sequence(F.lit(0), F.size("s") - 2), section)
    found = F.filter(each, lambda x: x["title"].isNotNull() | (x["text"] != ""))
    if max_pages is not None:
        found = F.slice(found, 1, max_pages)
    return starts.select("source", F.posexplode(found).alias("ord", "x")).select("source", "ord", "x.level", "x.title", "x.text")


#: Folders that a scan of code leaves out, besides all that begin with a dot.
EXCLUDED = {
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", "target", ".next", ".cache",
    ".tox", "site-packages", "coverage", "vendor", "bin", "obj", ".terraform", ".gradle",
}
#: Suffixes of files that a scan of code takes.
SUFFIXES = {
    "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "java", "go", "rs", "rb", "php", "c", "cc", "cpp", "cxx", "h", "hpp", "hh", "cs", "swift", "kt", "kts", "scala", "sh", "bash", "zsh", "ps1",
    "sql", "r", "jl", "lua", "dart", "ex", "exs", "clj", "hs", "ml", "vue", "svelte", "html", "htm", "css", "scss", "sass", "less", "md", "rst", "txt", "toml", "yaml", "yml", "json", "ini", "cfg",
    "conf", "xml", "gradle", "properties", "env", "tf", "proto", "graphql",
}
#: Names of files that it takes whatever their suffix.
NAMES = {"Dockerfile", "Makefile", "README", "LICENSE", "CMakeLists.txt", "requirements.txt", "pyproject.toml", "package.json", "go.mod", "Cargo.toml"}
#: Suffixes of prose.
PROSE = {"md", "rst", "txt"}
#: What fences call the language of a suffix.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "bash": "bash", "ps1": "powershell",
    "sql": "sql", "lua": "lua", "html": "html", "htm": "html", "css": "css", "scss": "scss", "vue": "vue", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml",
    "proto": "proto", "graphql": "graphql",
}


def tree_names(root: str, max_bytes: int = 500_000) -> list[str]:
    """Files of a tree that a scan of code takes, by name and size, in order: excluded folders aren't entered."""
    fs, top = file_system(root)
    out, folders = [], [top.rstrip("/")]
    while folders:
        for x in fs.get_file_info(pafs.FileSelector(folders.pop())):
            if x.type == pafs.FileType.Directory:
                if x.base_name not in EXCLUDED and not x.base_name.startswith("."):
                    folders.append(x.path)
            elif x.size <= max_bytes and (x.base_name in NAMES or re.sub(r"^.[^.]*$|^.+\.", "", x.base_name).lower() in SUFFIXES):
                out.append(x.path[len(top.rstrip("/")) + 1 :])
    return sorted(out)


def code_files(spark: SparkSession, root: str, max_bytes: int = 500_000) -> DataFrame:
    """path (below root), text, language (null: none known), prose of the text files of a tree that a wiki of it takes, in order of path. The driver lists names; tasks read the files."""
    files = read_files(spark, root, tree_names(root, max_bytes)).filter(F.expr("position(X'00', substring(content, 1, 8192)) = 0"))
    suffix = F.lower(F.regexp_extract(F.element_at(F.split("name", "/"), -1), r"^.+\.([^.]+)$", 1))
    lang = F.coalesce(*[F.when(suffix == k, v) for k, v in LANGUAGES.items()])
    return files.select(F.col("name").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), lang.alias("language"), suffix.isin(*sorted(PROSE)).alias("prose")).orderBy("path")


def code_sections(files: DataFrame, name: str, max_pages: int | None = None) -> DataFrame:
    """source, ord, level, title, text of code_files: an overview that lists the files, then a page a file, code in a fence of four backticks. max_pages: with the overview."""
    numbered = prefix.numbered(files.select("path"), [], ["path"], "ord").withColumn("ord", F.col("ord").cast("int"))  # paths alone: a listing, not the texts
    if max_pages is not None:
        numbered = numbered.filter(F.col("ord") <= max(0, max_pages - 1))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: F.concat(F.lit("- `"), x["path"], F.lit("`"))), "\n")
    tree = F.when(F.count("*") > 0, listed).otherwise("*(no source files found)*")
    text = F.concat(F.lit(f"# {name}\n\n"), F.count("*").cast("string"), F.lit(" source file(s).\n\n## Files\n\n"), tree)
    overview = numbered.agg(text.alias("text")).select(F.lit(0).alias("ord"), F.lit(1).alias("level"), F.lit(name).alias("title"), "text")
    fenced = F.concat(F.lit("````"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n````"))
    body = F.concat(F.lit("`"), "path", F.lit("`\n\n"), F.when(F.col("prose"), F.col("text")).otherwise(fenced))
    each = files.join(numbered, "path").select("ord", F.lit(2).alias("level"), F.col("path").alias("title"), body.alias("text"))
    return overview.unionByName(each).withColumn("source", F.lit(name)).select("source", "ord", "level", "title", "text")


def eval_set(lines: DataFrame) -> DataFrame:
    """question, expected of lines(value): JSON with ``pages`` or ``expected``, one or several; blank and # lines don't count."""
    rows = lines.withColumn("value", strip(F.col("value"))).filter("value <> '' and not startswith(value, '#')")
    raw: Column = F.coalesce(F.get_json_object("value", "$.pages"), F.get_json_object("value", "$.expected"))
    many = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return rows.select(F.get_json_object("value", "$.question").alias("question"), F.when(raw.isNotNull(), many).otherwise(F.array().cast("array<string>")).alias("expected"))
